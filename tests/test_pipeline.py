import random
import re
from collections import defaultdict

from edgewright.functions import names
from edgewright.operators import dedup, pipeline


def unbracketed(name):
    m = re.match(r"^(.+?)\s*\[([^\]]+)\]\s*$", name)
    if not m:
        return name
    family, attrs = m[1], {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in m[2].split(",") if "=" in p)}
    if attrs.get("version"):
        family = re.sub(r"\s+\d+(?:\.\d+)?\s*$", f" {attrs['version']}", family)
    return "-".join([family.strip(), *(attrs[k] for k in ("size", "variant", "stage", "track") if attrs.get(k))]).replace(" ", "-")


def signature(name):
    m = re.search(r"\(([^)]+)\)\s*$", name.strip())
    paren = m and m[1].strip().lower()
    if paren and "/" in paren and not any(k in paren for k in ("split", "subset", "variant", "ablation", "config", "version", "diamond")):
        paren = None
    m = re.search(r"\[([^\]]+)\]", name)
    pairs = [(k.strip().lower(), v.strip().lower()) for k, v in (p.split("=", 1) for p in m[1].split(",") if "=" in p)] if m else []
    core = re.sub(r"\s*\[[^\]]*\]\s*", "", re.sub(r"\s*\([^)]*\)\s*", "", unbracketed(name))).strip()
    m = re.match(r"^([A-Za-z0-9][A-Za-z0-9_.\-]*)/(.+)$", core)
    org, bare = (m[1].lower(), m[2]) if m else (None, core)
    norm = re.sub(r"-+", "-", re.sub(r"[\s_]+", "-", bare.lower().strip())).strip("-")
    sizes = frozenset(re.findall(r"\b(\d+(?:\.\d+)?)[Bb]\b", name))
    versions = frozenset(v.replace("_", ".") for v in re.findall(r"\b(\d+(?:[\._]\d+)+|\d+)\b", name) if len(v) <= 8) - sizes
    dates = frozenset(d for d in re.findall(r"(?<!\d)(0[1-9]\d{2}|1[0-2]\d{2})(?!\d)", name) if 1000 < int(d) < 2030) - versions - sizes
    return org, norm, norm.replace("-", "").replace(".", ""), versions, sizes, frozenset(k for k in names.STAGES if k in name.lower()), dates, paren, frozenset(p for p in pairs if p[0] not in ("size", "version", "stage", "track"))


def can_merge(a, b):
    return a[2] == b[2] and a[7:] == b[7:] and not any(a[i] and b[i] and a[i] != b[i] for i in (0, 3, 4, 5, 6))


def canonical(degree):
    clusters = defaultdict(list)
    for n in degree:
        clusters[signature(n)].append(n)
    final = defaultdict(list)
    for sig, members in clusters.items():
        fit = [c for c in clusters if sig[0] is None and c[0] and can_merge(sig, c)]
        final[min(fit, key=lambda c: (-sum(degree[n] for n in clusters[c]), min(clusters[c]))) if fit else sig] += members
    out = {}
    for members in final.values():
        best = max([n for n in members if "/" in n and not n.startswith("/")] or members, key=lambda n: (degree[n], len(n), n))
        out |= {n: best for n in members}
    return out


def test_canonical_map_against_brute_force(spark):
    rng = random.Random(6)
    stems = ["Foo-7B", "Foo_7B", "foo 7b", "Foo.7B", "Foo-7B-Base", "Foo-v1125", "Foo-v1025", "Foo v1125", "Bar 3 [size=7B, stage=Base]", "Bar-3-7B-Base", "Bar 3 [ablation=x]", "Bar-3", "Bar 3 (STEM)", "Bar 3 (org/bar-3)", "Bar 3 [version=3.1, size=7B]", "Bar-3.1-7B", "x1", "X 1"]
    degree = {n: rng.randrange(1, 9) for n in sorted(set(stems) | {f"{rng.choice(['Org', 'lab', 'a.b'])}/{s}" for s in stems for _ in range(2)})}
    got = {r.name: r.canonical for r in pipeline.canonical_map(spark.createDataFrame(list(degree.items()), "name string, degree long")).collect()}
    assert got == canonical(degree)
    assert any("/" not in n and "/" in c.split(" (")[0] for n, c in got.items())


def test_bare_name_goes_to_the_cluster_of_greatest_degree(spark):
    degree = [("Foo-7B", 1), ("foo 7B", 1), ("a/Foo-7B", 4), ("b/Foo-7B", 3), ("b/foo_7B", 2), ("c/Foo-7B (STEM)", 9)]
    got = {r.name: r.canonical for r in pipeline.canonical_map(spark.createDataFrame(degree, "name string, degree long")).collect()}
    assert got["Foo-7B"] == got["foo 7B"] == "a/Foo-7B" and got["b/foo_7B"] == "b/foo_7B" and got["b/Foo-7B"] == "b/Foo-7B"
    assert {r.members for r in dedup.signature_buckets(spark.createDataFrame(degree, "name string, degree long")).collect()} == {1, 2}


EDGE = "rel_id string, load_no int, subject string, relation string, dependency_kind string, object string, description string, anchor_list array<struct<source:string,position:string,excerpt:string,explanation:string>>"
ITEM = "item_id long, family string, kind string, formal_name string, identity array<struct<k:string,v:string>>, aliases array<string>, links array<struct<kind:string,url:string>>, description string, subsets array<string>"


def test_reconcile_passes_evidence_on(spark):
    """The general edge is subsumed by the specific ones, which inherit its anchors; the last specific one is named."""
    a = lambda s: [(s, None, None, "x")]
    rows = [
        ("r1", 0, "Foo [family=Foo]", "trained_on", "direct", "Bar [size=7B]", "general", a("g")), ("r2", 0, "Foo [size=7B]", "trained_on", "direct", "Bar [size=7B]", "special", a("s")),
        ("r3", 0, "Foo [size=7B, stage=Base]", "trained_on", "direct", "Bar [size=7B]", "more", a("m")), ("r4", 0, "Foo [size=7B]", "trained_on", "indirect", "Bar [size=7B]", "other kind", a("k")), ("r5", 0, "Foo []", "trained_on", "direct", "Bar [size=7B]", None, a("h")),
    ]
    e, items = spark.createDataFrame(rows, EDGE), spark.createDataFrame([], ITEM)
    got = {r.first_id: r for r in pipeline.reconciled(e, items).collect()}
    assert got["r1"].subsumed_by == "r3" and got["r2"].subsumed_by == "r3" and got["r3"].subsumed_by is None and got["r4"].n_subsumes == 0
    assert (got["r2"].n_subsumes, [x.source for x in got["r2"].inherited]) == (1, ["g", "h"])  # r1 and r5 have one identity
    assert (got["r3"].n_subsumes, [x.source for x in got["r3"].inherited]) == (2, ["g", "h", "s"])
    assert [x.source for x in got["r2"].anchor_list] == ["s"]


def test_viewer_under_a_filter(spark):
    from edgewright.operators import viewer as V

    link = [("paper", "http://p"), ("hf_model", " "), ("github", "http://g"), ("hf_model", "http://m"), ("odd", "http://o")]
    items = spark.createDataFrame([(1, "F", "model", "A", [], [], link, "text", []), (2, "F", "dataset", "B", [], [], [("blog", "http://b")], None, []), (3, "F", "dataset", "C", [], [], [("paper", "http://c")], None, []), (4, "F", "model", "D", [], [], [], None, []), (5, "G", "model", "A", [], [], link[:1], None, []), (6, None, "model", "", [], [], link, None, [])], ITEM)
    rows = [("r1", 0, "A", "trained_on", "direct", "B", None, []), ("r2", 0, "B", "trained_on", "direct", "C", None, []), ("r3", 0, "A", "cited_as_baseline", "indirect", "X", None, []), ("r4", 0, "A", "odd", "direct", "D", None, None), ("r5", 0, None, "odd", None, "A", None, [])]
    records = V.edge_records(spark.createDataFrame(rows, EDGE), items)
    nodes = V.node_records(records, items)
    n = {r.id: r for r in nodes.collect()}
    assert (n["A"].primary_url, n["A"].primary_link_kind, n["A"].n_links, n["A"].in_degree, n["A"].out_degree, n["A"].family) == ("http://p", "paper", 1, 1, 3, "G")
    assert (n["text::X"].kind, n["text::X"].description, n["text::X"].in_degree) == ("off_lattice", "X", 1)
    e = {r.rel_id: r for r in records.collect()}
    assert (e["r3"].relation_class, e["r3"].known_relation, e["r5"].subject_id, e["r1"].relation_class) == ("noise", False, "", "lineage")
    shown, at = V.view(records, nodes, ("model",), ("direct",))
    assert {r.rel_id for r in shown.collect()} == {"r1"} and {r.id for r in at.collect()} == {"A", "B"}
    first = V.lattice_nodes(items.where("item_id = 1")).first()
    assert (first.primary_url, first.primary_link_kind) == ("http://m", "hf_model")
    assert {r.rel_id for r in V.ego(records, "B").collect()} == {"r1", "r2"}


def test_hints_and_roles(spark):
    from edgewright.operators import lattice as L

    f = lambda **k: [("family", "F"), *k.items()]
    items = spark.createDataFrame([
        (1, "F", "model", "org/F", f(), ["F"], [("blog", "http://b/x")], None, ["sub-one", "Sub Two+"]), (2, "F", "model", "org/F-7B", f(size="7B"), ["F 7B"], [("hf_model", "https://huggingface.co/org/F-7b")], None, []),
        (3, "F", "model", "org/F-7B-Base", f(size="7B", stage="Base"), ["sub one"], [("hf_model", "https://huggingface.co/org/other/tree")], None, []), (4, "F", "model", "SubTwo+", f(stage="Base"), [], [("github", "https://x.example/")], None, None),
    ], ITEM)
    hints = {(r.hint, r.item_id, r.detail) for r in L.hints(items).collect()}
    assert {h for h in hints if h[0] in ("subset_with_anchor", "concept_subsumed_candidate", "formal_name_vs_canonical_url_mismatch")} == {
        ("subset_with_anchor", 2, "3"), ("concept_subsumed_candidate", 4, "3"), ("formal_name_vs_canonical_url_mismatch", 3, "org/other"),
    }
    assert {(r.item_id, r.parent_id) for r in L.name_matches_subset(items).collect()} == {(3, 1), (4, 1)}
    assert {r.item_id: r.role for r in L.item_roles(items).collect()} == {1: "family-root", 2: "canonical", 3: "canonical", 4: "concept"}
    piled = spark.createDataFrame([("G",)], "name string")
    assert [r.item_id for r in L.invented_root_aliases(items, piled).collect()] == [1]
    canon = spark.createDataFrame([("org/F-7B-Base", "org/F-7B"), ("SubTwo+", None)], "name string, canonical string")
    assert {(r.name, r.item_id, r.alias_count) for r in L.rebuilt(items, canon).collect()} == {("org/F", 1, 1), ("org/F-7B", 2, 2)}
