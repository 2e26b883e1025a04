import random
import unicodedata

from edgewright.llm import canon, copies, survivors
from edgewright.runtime import Stage
from pyspark.sql import functions as F

REL = "rel_id string, load_no int, subject string, relation string, object string"


def names(spark, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.c for r in df.select("i", canon.canonical(canon.prepared(F.col("v"))).alias("c")).orderBy("i").collect()]


def test_canonical_forms(spark):
    same = names(spark, "Org/Foo-Bar-1.5B-Base", " ORG / foo_bar 1.5b--BASE.", "“Ｏｒｇ/Ｆｏｏ‑Ｂａｒ-1.5Ｂ-base”", "org/Foo ​Bar 1.5B­Base️")
    assert len(set(same)) == 1
    a, b, c = names(spark, "Foo [size=1.5B, stage=Base]", "foo[ STAGE = base ; size=1.5b ]", "Foo [size=15B, stage=Base]")
    assert a == b != c
    assert names(spark, "Foo 1.5B")[0] != names(spark, "Foo 15B")[0]
    assert names(spark, None, "", "??") == [None, "", ""]
    e = unicodedata.normalize("NFD", "Café")
    assert names(spark, e)[0] == names(spark, "CAFÉ")[0]


def test_found_against_brute(spark):
    rng = random.Random(3)
    base = [f"Org/Name{chr(97 + i)}-{s}B" for i in range(12) for s in ("1.5", "15")]
    write = [str, str.upper, lambda s: s.replace("-", "_"), lambda s: f" ({s}) ", lambda s: s.replace("/", " / ")]
    rows, truth = [], {}
    for i in range(400):
        s, o = ("Org/Hot-7B", "Org/Hot-8B") if rng.random() < 0.4 else (rng.choice(base), rng.choice(base[:3]))
        truth.setdefault((s, o), []).append(f"r{i:05d}")
        rows.append((f"r{i:05d}", 0, rng.choice(write)(s), "rel", rng.choice(write)(o)))
    rows += rows[:30]
    rows += [("n1", 0, None, "rel", "x"), ("n2", 0, "x", "rel", " "), ("n3", 0, "x", None, "y"), ("n4", 0, "X", None, "Y"), (None, 0, "x", "rel", "y")]
    want = {(min(v), x) for v in truth.values() for x in v if x != min(v)} | {("n3", "n4")}
    df = spark.createDataFrame(rows, REL).selectExpr("*", "1 as key", "2 as n", "3 as h1")
    assert {tuple(r) for r in copies.found(df).collect()} == want
    total = copies.collapsed(df)
    assert total.agg(F.sum("copies")).first()[0] == 402 and total.count() == len(truth) + 1
    assert copies.found(df.limit(0)).count() == 0


def test_radix_splits_oversized_buckets(spark):
    keys = [f"prefix{'x' * (i % 5)}{i:04d}" for i in range(300)] + ["prefix"] * 50 + ["prefixx"]
    rows = spark.createDataFrame([(f"r{i:04d}", k) for i, k in enumerate(keys)], "rel_id string, key string")
    got = {r.key: (r.first_id, r.n) for r in copies.radix_count(Stage(spark, "t"), rows, bucket_rows=20).collect()}
    want = {}
    for i, k in enumerate(keys):
        f, n = want.get(k, (f"r{i:04d}", 0))
        want[k] = (min(f, f"r{i:04d}"), n + 1)
    assert got == want


def test_radix_below_a_long_common_prefix(spark, monkeypatch):
    """Oversized prefixes over several passes, by broadcast and by shuffle."""
    keys = [f"{'p' * 17}{i % 3}{'q' * 3}{i:04d}" for i in range(400)]
    rows = spark.createDataFrame([(f"r{i:04d}", k) for i, k in enumerate(keys)], "rel_id string, key string")
    for most in (10_000, 3):
        monkeypatch.setattr(copies, "PREFIX_ROWS", most)
        assert {r.key: (r.first_id, r.n) for r in copies.radix_count(Stage(spark, "t"), rows, bucket_rows=30).collect()} == {k: (f"r{i:04d}", 1) for i, k in enumerate(keys)}


def test_trie():
    t = copies.Trie()
    for k in ["", "a", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "a"]:
        t.add(k, k + "1", 1)
    assert {x[3]: x[2] for x in t.terminals()} == {"": 1, "a": 2, "ab": 1, "abcdefgh": 1, "abcdefghi": 1, "abcdefghijklmnopq": 1}


A = "array<struct<source:string,position:string,excerpt:string,explanation:string>>"


REC = f"rel_id string, subject string, relation string, object string, description string, anchor_list {A}, recorded_at string, dependency_kind string, origin string"
CLUSTERS = f"cluster_id string, members array<struct<member_no:int,system:string,subject:string,relation:string,object:string,description:string,anchor_list:{A},recorded_at:timestamp>>"
LABELS = "label string, dependency_kind string"


def test_survivors_ties_and_stand_ins(spark):
    good, part = ("s", None, None, "e"), ("s", None, None, " ")
    rows = [
        ("r1", "a", "x", "y", "N/A", [good, good, None], None, "direct", "pipeline"), ("r2", "A", "x", "Y", "two  words", None, None, None, "pipeline"), ("r3", "a.", "x", "y", "two words", [part], "2025-01-01 00:00:00", "direct", "pipeline"),
        ("s1", "b", "x", "y", "A single edge is no group.", [], None, "direct", "pipeline"), ("t1", "c", "x", "y", "Description will be added once somebody has time for it.", [], None, "direct", "pipeline"), ("t2", "C", "x", "y", None, None, None, None, None),
        ("r2", "A", "x", "Y", "two  words", None, None, None, "pipeline"), ("s1", "b", "x", "y", "A single edge is no group.", [], None, "direct", "pipeline"),
    ]
    rel = spark.createDataFrame(rows, REC).withColumn("recorded_at", F.to_timestamp("recorded_at")).selectExpr("*", "1 as h1", "'x' as key", "2 as d_len")
    member = lambda no, system: (no, system, "S", "x", "O", "same", [good], None)
    clusters = spark.createDataFrame([("k1", [member(1, "low"), member(2, "high"), member(3, None)]), ("k2", None), ("k3", []), (None, [])], CLUSTERS)
    systems = spark.createDataFrame([("low", 1), ("high", 9)], "system string, trust int")
    labels = spark.createDataFrame([("x", "indirect")], LABELS)
    got = {tuple(r) for r in survivors.found(rel, clusters, systems, labels).collect()}
    assert got == {("relation", "r1", "r3", "r1"), ("relation", "t1", "", ""), ("cluster", "k1", "2", "2"), ("cluster", "k2", "", ""), ("cluster", "k3", "", "")}
    full = {r.group_key: r for r in survivors.survivors(rel, clusters, systems, labels).collect()}
    assert full["r1"].description == "two words" and full["r1"].anchors_from == "r1" and len(full["r1"].anchor_list) == 3 and full["t1"].description is None
    assert full["r1"].dependency_kind == "direct" and full["t1"].dependency_kind == "direct" and full["k1"].maker == "high"
    assert survivors.found(rel.limit(0), clusters.limit(0), systems, labels).count() == 0


def test_survivors_keep_the_dependencies(spark):
    """Names and maker come from records of one class, the label agrees with the relation, against all combinations."""
    import itertools

    rng = random.Random(11)
    rows = [(f"r{i:03d}", rng.choice(["org/Name", "ORG/name", "org name"]), "x", f"O{i % 25}", None, None, f"2025-01-{rng.randrange(1, 28):02d} 00:00:00", rng.choice(["direct", "Indirect ", "?", None]), rng.choice(["pipeline", "manual", None])) for i in range(200)]
    rel = spark.createDataFrame(rows, REC).withColumn("recorded_at", F.to_timestamp("recorded_at"))
    none = spark.createDataFrame([], CLUSTERS)
    got = survivors.survivors(rel, none, spark.createDataFrame([], "system string, trust int"), spark.createDataFrame([("x", "indirect")], LABELS)).collect()
    kind = lambda r: {"direct": 0, "indirect": 1}.get((r[7] or "").strip().lower(), 2)
    made = lambda r: {"pipeline": 0, "manual": 1}.get(r[8], 2)
    late = lambda r: (-int(r[6][8:10]), r[0])
    assert len(got) == 25
    for g in got:
        rs = [r for r in rows if r[3] == f"O{int(g.group_key[1:]) % 25}"]
        best = {"label": {}, "maker": {}, "names": {}}
        for r in rs:
            for b, c, rank in (("label", kind(r), late(r)), ("maker", made(r), late(r)), ("names", made(r), (-("/" in r[1]), *late(r)))):
                best[b][c] = min(best[b].get(c, (rank, r)), (rank, r))
        trust = {b: {c: sum(o[0] >= v[0] for o in cs.values()) for c, v in cs.items()} for b, cs in best.items()}
        options = [o for o in itertools.product(*best.values()) if o[1] == o[2]]
        options = [o for o in options if o[0] == 1] or options
        total = lambda o, trust=trust: sum(t[c] for t, c in zip(trust.values(), o))
        row = {r[0]: r for r in rs}
        taken = (kind(row[g.label_from]), made(row[g.maker_from]), made(row[g.names_from]))
        assert taken in options and total(taken) == max(map(total, options))
        assert [best[b][c][1][0] for b, c in zip(best, taken)] == [g.label_from, g.maker_from, g.names_from]


def test_branch_and_bound_against_brute():
    import itertools

    rng = random.Random(5)
    for _ in range(200):
        bundles = [[(rng.randrange(9), {"k" if rng.random() < 0.5 else f"b{b}": rng.randrange(3), f"x{b}": i}) for i in range(rng.randrange(1, 4))] for b in range(3)]
        ok = lambda f: f.get("k", 1) != 0 and f.get("b0") != f.get("b1", -1)

        def total(choice, ok=ok):
            f = {}
            for _, v in choice:
                f = f | v
                if not ok(f):
                    return None
            return sum(t for t, _ in choice)

        want = max((t for c in itertools.product(*bundles) if (t := total(c)) is not None), default=None)
        got = survivors.branch_and_bound(bundles, ok)
        assert (got is None) == (want is None)
        if got is not None:
            assert sum(next(t for t, v in b if v is g) for b, g in zip(bundles, got)) == want
