import random

from edgewright.functions import names
from edgewright.operators import dedup, edges, evaluate, graph, lattice
from pyspark.sql import functions as F

EDGE = "rel_id string, load_no int, subject string, relation string, dependency_kind string, object string, description string, anchor_list array<struct<source:string,position:string,excerpt:string,explanation:string>>"


def table(spark, triples):
    return spark.createDataFrame([(f"r{i:04d}", 0, s, r, "direct", o, f"d{i}", []) for i, (s, r, o) in enumerate(triples)], EDGE)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60):02d}", "trained_on", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{i:03d}", "r", f"c{i + 1:03d}") for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for s, _, o in pairs:
        a, b = sorted((find(s), find(o)))
        root[b] = a
    got = {r.node: r.component for r in graph.components(table(spark, pairs)).collect()}
    assert got == {n: find(n) for n in root}


def test_components_with_a_hub_and_a_shuffled_chain(spark):
    order = list(range(120))
    random.Random(8).shuffle(order)
    pairs = [("hub", "r", f"h{i:04d}") for i in range(1500)] + [(f"z{a:03d}", "r", f"z{b:03d}") for a, b in zip(order, order[1:])] + [("lone", "r", "lone")]
    got = {r.node: r.component for r in graph.components(table(spark, pairs)).collect()}
    assert got["hub"] == got["h1499"] == "h0000" and {got[f"z{i:03d}"] for i in order} == {"z000"} and got["lone"] == "lone"


def test_components_empty(spark):
    assert graph.components(table(spark, [])).count() == 0


def test_ego_expansion_budget_and_ties(spark):
    e = table(spark, [("seed", "trained_from", "a"), ("b", "trained_on", "seed"), ("seed", "inspired_by", "c"), ("a", "trained_on", "d"), ("z", "r", "y")])
    seeds = spark.createDataFrame([("seed",)], "node string")
    got = [(r.node, r.round) for r in graph.ego_expansion(e, seeds, 2, 4).collect()]
    assert sorted(got) == [("a", 1), ("b", 1), ("c", 1), ("seed", 0)]
    got = {r.node for r in graph.ego_expansion(e, seeds, 1, 3).collect()}
    assert got == {"seed", "a", "b"}
    assert {r.node for r in graph.ego_expansion(e, seeds, 5, 100).collect()} == {"seed", "a", "b", "c", "d"}


def test_ancestors_with_cycle(spark):
    e = table(spark, [("s", "trained_on", "a"), ("a", "trained_from", "b"), ("b", "trained_on", "s"), ("a", "used_for_evaluation", "x")])
    got = {(r.node, r.depth) for r in graph.ancestors(e, spark.createDataFrame([("s",), ("none",)], "seed string")).collect() if r.seed == "s"}
    assert got == {("s", 0), ("a", 1), ("b", 2)}


def test_beam_adds_votes_up(spark):
    e = table(spark, [("s", "r", "a"), ("s", "q", "a"), ("s", "r", "b"), ("a", "r", "c"), ("a", "r", "b"), ("b", "r", "d")])
    got = {(r.round, r.node, r.votes) for r in graph.beam(e, spark.createDataFrame([("s",)], "node string"), 1, 3).collect()}
    assert got == {(1, "a", 2), (2, "b", 3), (3, "c", 2)}  # b: 1 vote in the first round, 2 in the second


def test_unions_keep_stages_apart(spark):
    nodes = spark.createDataFrame([("Foo", 1), ("o/Foo-Base", 1), ("o/Foo-Instruct", 1)], "name string, degree long")
    prop = spark.createDataFrame([("c", "1", "Foo", "o/Foo-Base"), ("c", "2", "Foo", "o/Foo-Instruct")], "component string, ord string, a string, b string")
    got = {r.name: (r.component, r.refused) for r in dedup.guarded_unions(prop, dedup.name_specs(nodes)).collect()}
    assert got == {"Foo": ("Foo", 1), "o/Foo-Base": ("Foo", 1), "o/Foo-Instruct": ("o/Foo-Instruct", 1)}


def test_evidence_of_merged_edges(spark):
    a = lambda i: (f"s{i}", None, None, f"x{i}")
    rows = [
        ("r1", 2, "s", "r", "direct", "o", "one", [a(1), None]), ("r2", 0, "s", "r", "direct", "o", "two", [a(2)]), ("r3", 2, "s", "r", "direct", "o", "one", None), ("r4", 1, "s", "r", "indirect", "o", "three", [a(1), a(3)]),
        ("r5", 0, "t", "r", None, "o", None, []), ("r6", None, "t", "r", None, "o", "late", [a(4)]), ("r7", 0, "s", "r", "direct", "o", "two", [a(5)]),
    ]
    e = spark.createDataFrame(rows, EDGE)
    c = {r.first_id: r for r in edges.corroborated(e).collect()}
    src = lambda r: [x.source for x in r.anchor_list]
    assert (c["r1"].description, c["r1"].variants, src(c["r1"]), c["r1"].loads, c["r1"].corroboration) == ("one", ["two"], ["s1", "s2", "s5"], [0, 2], 4)
    assert c["r5"].description is None and c["r5"].variants == [] and src(c["r5"]) == ["s4"]
    m = {r.first_id: r for r in edges.merged_relations(e).collect()}
    assert (m["r1"].dependency_kind, m["r1"].variants, src(m["r1"])) == ("direct", ["one", "two", "three"], ["s1", "s2", "s1", "s3", "s5"])
    assert {(r.n_variants, tuple(r.variants)) for r in edges.description_conflicts(e).collect()} == {(2, ("one", "two")), (3, ("one", "two", "three"))}
    canon = spark.createDataFrame([("t", None), ("s", "S")], "name string, canonical string")
    w = edges.rewritten(e, canon, cap_anchors=2).collect()
    assert [(r.subject, src(r), r.merged) for r in w] == [("S", ["s1", "s2"], 5)]
    assert tuple(edges.rewrite_losses(e, canon).first()) == (2, 0)


def test_rewire(spark):
    e = table(spark, [("a", "trained_on", "x"), ("x", "trained_on", "b"), ("x", "inspired_by", "c"), ("a", "trained_on", "k"), ("x", "trained_on", "k")])
    got = {(r.subject, r.relation, r.object, r.via) for r in edges.rewired(e, spark.createDataFrame([("x",)], "node string")).collect()}
    assert got == {("a", "trained_on", "k", None), ("a", "trained_on", "b", "x")}


def test_guarded_unions_refuse(spark):
    nodes = spark.createDataFrame([("OLMo-2-7B", 1), ("OLMo-2-32B", 1), ("OLMo-2", 1)], "name string, degree long")
    prop = spark.createDataFrame([("c", "1", "OLMo-2", "OLMo-2-7B"), ("c", "2", "OLMo-2", "OLMo-2-32B")], "component string, ord string, a string, b string")
    got = {r.name: (r.component, r.refused) for r in dedup.guarded_unions(prop, dedup.name_specs(nodes)).collect()}
    assert got["OLMo-2"][0] == got["OLMo-2-7B"][0] != got["OLMo-2-32B"][0] and got["OLMo-2"][1] == 1


def test_affix_brute(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 8))) for _ in range(40)]
    ns = sorted({w for w in words[:20]} | {f"org/{w}" for w in words})
    nodes = spark.createDataFrame([(n, 1) for n in ns], "name string, degree long")
    got = {tuple(r) for r in dedup.affix_pairs(nodes).collect()}
    want = {(a, b) for a in ns for b in ns if "/" not in a and "/" in b and len(a) >= 4 and (b[4:].startswith(a) or b[4:].endswith(a))}
    assert got == want


def test_edge_subsumption(spark):
    f = "array<string>"
    rows = [("r1", "t", "d", "A", ["family=A"], "B", ["family=B"]), ("r2", "t", "d", "A", ["family=A", "size=1"], "B", ["family=B"]), ("r3", "t", "d", "A", ["family=A", "size=1"], "B", ["family=B", "v=2"]), ("r4", "t", "d", "A", ["family=A", "size=1"], "B", ["family=B", "v=3"])]
    e = spark.createDataFrame(rows, f"rel_id string, relation string, kind string, s_family string, s_facets {f}, o_family string, o_facets {f}")
    assert {tuple(r) for r in lattice.edge_subsumption(e).collect()} == {("r1", "r2"), ("r1", "r3"), ("r1", "r4"), ("r2", "r3"), ("r2", "r4")}
    assert {tuple(r) for r in lattice.sibling_conflicts(e).collect()} == {("r3", "r4")}


def test_expansion(spark):
    item = "item_id long, family string, kind string, formal_name string, identity array<struct<k:string,v:string>>, links array<struct<kind:string,url:string>>"
    t = spark.createDataFrame([(1, "F", "model", "F", [("family", "F")], None), (2, "F", "model", "x", [("family", "F"), ("size", "1B"), ("stage", "Base")], None), (3, "F", "model", "y", [("size", "1B"), ("family", "F")], None)], item)
    assert {r.facets for r in lattice.expanded(lattice.items_of(t)).collect()} == {"stage=Base"}


def test_name_functions(spark):
    n = F.col("n")
    df = spark.createDataFrame([("OLMo-2-0325-32B",), ("Org/Foo Bar_7B (x)",), ("Qwen3 [size=4B, stage=Base]",), ("Foo [a]",), ("",)], "n string")
    got = df.select(names.canonical_name(n).alias("c"), names.sizes(n).alias("s"), names.dates(n).alias("d"), names.address_facets(n).alias("a"), names.truncate(n, 8).alias("t")).collect()
    assert got[0].s == ["32"] and got[0].d == ["0325"] and got[1].c == "org/foo-bar-7b-x" and got[2].a == ["family=Qwen3", "size=4B", "stage=Base"]
    assert got[3].a is None and got[4].a is None and got[0].t == "OLMo-..."


def test_resolve(spark):
    m = spark.createDataFrame([("Foo 7B",), ("zzz",), (None,), ("",)], "mention string")
    e = spark.createDataFrame([("e1", "foo-7b"), ("e2", "Foo 7B Base"), ("e3", None)], "entry_id string, surface string")
    assert {(r.mention, r.entry_id, r.score) for r in evaluate.resolved(m, e).collect()} == {("Foo 7B", "e1", 115.0)}
    low = {(r.mention, r.entry_id) for r in evaluate.resolved(m, e, floor=1).collect()}
    assert low == {("Foo 7B", "e1"), ("Foo 7B", "e2")}
