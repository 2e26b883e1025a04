import pytest
from edgewright.operators import graph


def test_ancestors_of_a_deep_chain(spark):
    e = spark.createDataFrame([(f"n{i}", "trained_from", f"n{i + 1}") for i in range(53)], "subject string, relation string, object string")
    seeds = spark.createDataFrame([("n0",)], "seed string")
    with pytest.raises(ValueError, match="farther than 3"):
        graph.ancestors(e, seeds, max_depth=3)
    assert {(r.node, r.depth) for r in graph.ancestors(e, seeds).collect()} == {(f"n{i}", i) for i in range(54)}
