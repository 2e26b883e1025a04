from edgewright.operators import graph


def test_batches_of_both_sides(spark):
    edge = "rel_id string, subject string, object string, anchor_list array<string>"
    rows = [(f"r{i:03d}", f"s{i % 3}", "sink", ["a"] * (i % 5)) for i in range(250)] + [("q", "sink", "s0", [])]
    hubs = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    got = {(r.hub, r.role, r.rel_id, r.batch_no) for r in graph.audit_batches(spark.createDataFrame(rows, edge), hubs("s0", "sink"), hubs("sink")).collect()}
    want = set()
    for hub, role, at in (("s0", "subject", 1), ("sink", "subject", 1), ("sink", "object", 2)):
        own = sorted((r for r in rows if r[at] == hub), key=lambda r: (-len(r[3]), r[0]))[:200]
        want |= {(hub, role, r[0], i // 40) for i, r in enumerate(own)}
    assert got == want
