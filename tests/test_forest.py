import random

from edgewright.plans import core_problems

RUN = "id string, stage string, parent_run_id string, started_at string, ended_at string"
ITEM = "item_id long, family string, identity array<struct<k:string,v:string>>"


def test_paths_and_descendants_of_runs_and_items(spark, tmp_path):
    rng = random.Random(5)
    parent = {f"r{i:02d}": f"r{rng.randrange(max(0, i - 2), i):02d}" if i else None for i in range(30)} | {"x1": "x2", "x2": "x1", "x3": "x1"}
    spark.createDataFrame([(i, "s", p, "1", "2") for i, p in parent.items()], RUN).write.parquet(f"{tmp_path}/runs.parquet")
    items = [(1, "F", []), (2, "F", [("a", "1")]), (3, "F", [("a", "1"), ("b", "2")]), (4, "G", [("a", "1")])]
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/lattice_items.parquet")
    above = {("run", i): p for i, p in parent.items()} | {("item", i): p for i, p in (("1", None), ("2", "1"), ("3", "2"), ("4", None))}
    paths, below = set(), set()
    for (kind, i), p in above.items():
        if i.startswith("x"):
            paths.add((kind, i, None, -1, ""))
            continue
        path = [i]
        while p:
            path.insert(0, p)
            p = above[kind, p]
        paths.add((kind, i, "/".join(path), len(path) - 1, path[0]))
        below |= {(kind, a, i, len(path) - 1 - n) for n, a in enumerate(path[:-1])}
    assert {tuple(r) for r in core_problems.p2_node_paths(spark, str(tmp_path)).collect()} == paths
    assert {tuple(r) for r in core_problems.p2_node_descendants(spark, str(tmp_path)).collect()} == below
