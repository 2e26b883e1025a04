"""Direct parents of the identity lattice against brute force."""

import random

from pyspark.sql import functions as F

from edgewright.operators import lattice

ITEM = "item_id long, family string, facets array<string>"


def direct_pairs(rows):
    """``family, parent, child`` by definition."""
    sets = {i: (f, frozenset(s)) for i, f, s in rows}
    under = lambda a, b: sets[a][0] == sets[b][0] and sets[a][1] < sets[b][1]
    return sorted((sets[a][0], a, b) for a in sets for b in sets if under(a, b) and not any(under(a, m) and under(m, b) for m in sets))


def test_items_are_read_once(spark):
    """Equal items are one set: they are read once, and no pairs of items are joined with each other."""
    chain = [["a=1", "b=1", "c=1", "family=F"][:n] for n in (1, 2, 3)]
    rows = [(100 * k + i, "F", s) for k, s in enumerate(chain) for i in range(20)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    got = sorted(tuple(r) for r in lattice.direct_parents(spark.createDataFrame(rows, ITEM).mapInPandas(counted, ITEM)).collect())
    assert got == direct_pairs(rows) and len(got) == 800
    assert read.value == len(rows)


def test_equal_and_wide_sets_against_brute_force(spark):
    rng = random.Random(7)
    few, many = [f"f{i}=v" for i in range(6)], [f"k{i:02d}=v" for i in range(18)]
    rows = [(i, rng.choice(["F", "G", ""]), sorted(rng.sample(few, rng.randint(0, 6)))) for i in range(150)]
    rows += [(200 + i, "W", sorted(rng.sample(many, rng.choice([0, 1, 2, 3, 13, 14, 15, 16, 17, 18])))) for i in range(60)]
    rows += [(300 + i, "W", many[:n]) for i, n in enumerate([18, 18, 16, 15, 15, 14, 12, 2, 0])]
    items = spark.createDataFrame(rows, ITEM).withColumn("facets", F.array_append("facets", F.concat(F.lit("family="), "family")))
    assert sorted(tuple(r) for r in lattice.direct_parents(items).collect()) == direct_pairs(rows)
