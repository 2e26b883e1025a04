import random

import pytest
from edgewright.operators import lattice


def test_wide_sets_against_brute_force(spark):
    rng = random.Random(3)
    facets = [f"k{i:02d}=v" for i in range(18)]
    sets = {i: sorted(rng.sample(facets, n)) for i, n in enumerate([0, 1, 1, 2, 3, 14, 15, 16, 17, 17, 18])}
    sets |= {20: sets[9][:16], 21: sets[9][:15], 22: sets[9][:2], 23: sets[9]}
    items = spark.createDataFrame([(i, f, s) for i, s in sets.items() for f in ["F"]], "item_id long, family string, facets array<string>")
    want = {("F", a, b) for a in sets for b in sets if set(sets[a]) < set(sets[b])}
    assert {tuple(r) for r in lattice.subsumed_pairs(items).collect()} == want
    direct = {p for p in want if not any(("F", p[1], m) in want and ("F", m, p[2]) in want for m in sets)}
    assert {tuple(r) for r in lattice.direct_parents(items).collect()} == direct
    with pytest.raises(Exception, match="more than 14 facets"):
        lattice.expanded(items).collect()


def test_wide_edges(spark):
    s, o = [f"s{i}=1" for i in range(8)], [f"o{i}=1" for i in range(8)]
    rows = [("r1", s, o), ("r2", s, o[:7]), ("r3", s[:2], o[:1]), ("r4", [], []), ("r5", ["z=1"], o)]
    f = "array<string>"
    e = spark.createDataFrame([(i, "t", "d", "A", a, "B", b) for i, a, b in rows], f"rel_id string, relation string, kind string, s_family string, s_facets {f}, o_family string, o_facets {f}")
    want = {(a, b) for a, x, y in rows for b, u, v in rows if a != b and set(x) <= set(u) and set(y) <= set(v)}
    assert {tuple(r) for r in lattice.edge_subsumption(e).collect()} == want
