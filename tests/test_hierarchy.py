import random

from edgewright.operators import hierarchy as H
from pyspark.sql import functions as F


def brute(links):
    """id -> (root, depth, subtree size) by walking; '' and -1 on and below loops."""
    parent = {i: p for i, p in links if i is not None}
    parent = {i: p if p in parent else None for i, p in parent.items()}
    out, size = {}, dict.fromkeys(parent, 0)
    for i in parent:
        path, x = [], i
        while x is not None and x not in path:
            path.append(x)
            x = parent[x]
        if x is None:
            out[i] = (path[-1], len(path) - 1)
            for a in path:
                size[a] += 1
        else:
            out[i] = ("", -1)
    return out, size, parent


def check(spark, links, wide=5):
    df = spark.createDataFrame(links, "id string, parent string").selectExpr("*", "1 as root", "'x' as depth")
    rows = {r.id: r for r in H.paths(H.nested_sets(df, wide_parent=wide)).collect()}
    want, size, parent = brute(links)
    assert {i: (r.root, r.depth) for i, r in rows.items()} == want
    by_root = {}
    for i, r in rows.items():
        if r.depth < 0:
            assert r.pre is None and r["size"] is None and r.path is None
            continue
        assert r["size"] == size[i]
        assert r.path[0] == r.root and r.path[-1] == i and len(r.path) == r.depth + 1
        by_root.setdefault(r.root, []).append(r)
    for members in by_root.values():
        assert sorted(r.pre for r in members) == list(range(len(members)))
        for r in members:
            inside = {m.id for m in members if r.pre < m.pre < r.pre + r["size"]}
            assert inside == {m.id for m in members if r.id in m.path[:-1]}


def test_random_forests(spark):
    rng = random.Random(1)
    links = [(f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else rng.choice([None, "gone"])) for i in range(60)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1"), ("self", "self"), (None, "n1")]
    check(spark, links)


def test_deep_chain_and_star(spark):
    check(spark, [(f"d{i}", f"d{i - 1}" if i else None) for i in range(70)] + [(f"s{i}", "d3") for i in range(40)])


def test_hot_parent_and_root(spark):
    """One parent with most rows, and chains of one root that share pointers in every round."""
    links = [("r", None), ("h", "r")] + [(f"k{i}", "h") for i in range(1500)] + [(f"g{i}", f"k{i}") for i in range(1200)] + [(f"f{i}", f"g{i}") for i in range(1100)] + [("x", "y"), ("y", "x")]
    check(spark, links, wide=100)


def test_blocks_cover_every_range(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.choice((1, 2, 17, 300, 5000, 70000))) for a in (rng.randrange(100_000) for _ in range(60))]
    df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", H._blocks(F.col("lo"), F.col("hi")).alias("b"))
    for r in df.collect():
        cut = sorted((b.no << b.bits, (b.no + 1) << b.bits) for b in r.b)
        assert cut[0][0] == r.lo and cut[-1][1] == r.hi and all(x[1] == y[0] for x, y in zip(cut, cut[1:]))


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [("only", None)])
    check(spark, [("loop", "loop")])


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "id string, parent string")
    got = {tuple(r) for r in H.descendants(H.nested_sets(df)).collect()}
    assert got == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_run_links(spark):
    u = "6aec288b-4fd3-4574-ac33-9fdefb713ef4"
    runs = spark.createDataFrame([(u, None, None), ("k", "{" + u.upper() + "} ", "2"), ("k", None, "1"), ("m", u.replace("-", ""), None), ("n", " ", None), (None, "k", None)], "id string, parent_run_id string, ended_at string")
    assert {(r.id, r.parent) for r in H.run_links(runs).collect()} == {(u, None), ("k", u), ("m", u), ("n", None)}


ITEM = "item_id long, family string, identity array<struct<k:string,v:string>>"


def test_facet_links_both_ways(spark):
    f = lambda *ks: [("family", "F")] + [(k[0], k) for k in ks]
    items = [
        (1, "F", f()), (2, "F", f("a1")), (3, "F", f("a1", "b1")), (4, " f ", [("b", " B1 "), ("a", "A1"), ("c", "c1"), ("n", " "), ("m", None)]), (5, "F", f("c2")), (6, "F", f("b1", "c2")),
        (7, "G", [("a", "a1"), ("b", "b1")]), (8, None, None), (3, "F", f("a1", "b1")), (9, "F", f("a1", "b1")),
    ]
    df = spark.createDataFrame(items, ITEM)
    want = {("1", None), ("2", "1"), ("3", "2"), ("9", "2"), ("4", "3"), ("5", "1"), ("6", "5"), ("7", None)}
    for wide in (12, 1):
        assert {(r.id, r.parent) for r in H.facet_links(df, wide).collect()} == want
    assert H.facet_links(df.limit(0)).count() == 0


def test_combined_forest(spark):
    runs = spark.createDataFrame([("a", None, None), ("b", "a", None)], "id string, parent_run_id string, ended_at string")
    items = spark.createDataFrame([(1, "F", []), (2, "F", [("s", "1B")])], ITEM)
    got = {(r.node_kind, r.node_id, r.root_id, r.depth) for r in H.combined_forest(spark, runs, items).collect()}
    assert got == {("run", "a", "a", 0), ("run", "b", "a", 1), ("item", "1", "1", 0), ("item", "2", "1", 1)}
