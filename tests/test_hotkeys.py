from edgewright.operators import hotkeys


def test_heavy_and_degrees(spark):
    rows = [("s", "r", "hub")] * 40 + [(f"s{i}", "r", f"o{i}") for i in range(60)] + [(None, "r", ""), ("s", None, "hub")]
    df = spark.createDataFrame(rows, "subject string, relation string, object string").selectExpr("*", "'x' as key_value", "1 as n")
    assert {tuple(r) for r in hotkeys.heavy_endpoints(df).collect()} == {("subject", "s"), ("object", "hub")}
    d = {r.artifact: r for r in hotkeys.degrees(df).collect()}
    assert (d["hub"].in_degree, d["hub"].out_degree, d["hub"].degree, d["hub"].n_relations) == (41, 0, 41, 1)
    assert "" not in d and None not in d


def test_threshold_is_met_exactly(spark):
    df = spark.createDataFrame([("a", "r", "x")] + [(f"s{i}", "r", None) for i in range(49)], "subject string, relation string, object string")
    assert {(r.field_name, r.key_value) for r in hotkeys.heavy_endpoints(df).collect()} == {("subject", "a"), ("object", "x")} | {("subject", f"s{i}") for i in range(49)}


def test_empty(spark):
    df = spark.createDataFrame([], "subject string, relation string, object string")
    assert hotkeys.heavy_endpoints(df).count() == 0 and hotkeys.degrees(df).count() == 0
