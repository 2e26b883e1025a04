import re

from edgewright.llm import history as H
from pyspark.sql import functions as F

SRC = "id string, load_no int, content_hash string, canonical_url string, created_at string"
REL = "rel_id string, load_no int, subject string, relation string, object string"
HASH = "ab" * 31 + "cd"


def sources(spark, rows):
    return spark.createDataFrame(rows, SRC).selectExpr("*", "1 as key", "2 as n", "'x' as first")


def test_addresses(spark):
    same = ["https://Hub.example/a/B-c", "HTTP://www.hub.example:443/a//B%2Dc/?utm_source=x&ref=n#top", " https://hub.example/a/B-c/ "]
    other = ["https://hub.example/a/b-c", "https://hub.example/a/B-c?page=2", "https://hub.example/a/B-c/tree/dev", "https://hub.example:8080/a/B-c"]
    none = ["n/a", "about:blank", "", None, "https://", "-"]
    rows = [(i, u) for i, u in enumerate(same + other + none)]
    got = [r.a for r in spark.createDataFrame(rows, "i int, u string").select("i", H.address(F.col("u")).alias("a")).orderBy("i").collect()]
    assert len(set(got[:3])) == 1 and len(set(got[:7])) == 5 and got[7:] == [None] * 6
    assert spark.createDataFrame([("https://d.example/v?b=2&a=1",), ("https://d.example/v?a=1&b=2&fbclid=9",)], "u string").select(H.address(F.col("u"))).distinct().count() == 1


def test_digests(spark):
    rows = [(HASH,), (f"SHA256:{HASH.upper()}",), (f" sha256-{HASH}\n",), ("0" * 64,), (H.EMPTY_DIGESTS[0],), ("n/a",), (None,)]
    got = [r.d for r in spark.createDataFrame(rows, "h string").select(H.digest(F.col("h")).alias("d")).collect()]
    assert got == [HASH] * 3 + [None] * 4


def test_sources_pair_with_the_first(spark):
    u = "https://hub.example/a/b"
    rows = [("s1", 0, HASH, None, "1"), ("s2", 1, HASH.upper(), u, "2"), ("s3", 2, None, u + "/", "3"), ("s4", 2, "n/a", "n/a", "4"), ("s5", 0, HASH, None, "0"), ("s2", 1, HASH.upper(), u, "2"), (None, 1, HASH, None, "9"), ("s6", 3, None, None, None)]
    empty = spark.createDataFrame([], REL)
    got = {tuple(r) for r in H.found(sources(spark, rows), empty).collect()}
    assert got == {("source", "s2", "s5"), ("source", "s2", "s3")}


RELS = [
    ("r1", 0, "org/Kubagisu-Bijeyo-8B-Think", "x", "T"), ("r2", 1, "ORG / kubagsu bijeyo 8b think", "x", "t"), ("r3", 1, "org/Kubagisu-Bijeyoo-8B-Think", "x", "T"), ("r4", 2, "org/Kubagisu-Bijeyo-3B-Think", "x", "T"),
    ("r5", 2, "org/Kubagisu-Bijeyo-8B-Base", "x", "T"), ("r6", 2, "org/Kbuagisu-Bijyeo-8B-Think", "x", "T"), ("r7", 2, "org/Kubagisu-Bijeyo-8B-Think", "y", "T"), ("r8", 3, None, "x", "T"), ("r9", 3, "org/Wholly-Other-8B-Think", "x", "T"),
    ("ra", 3, "Kubagisu [size=8B, stage=Think]", "x", "T"), ("rb", 4, "Kubagisuu [stage=think; size=8b]", "x", "T"), ("r6", 2, "org/Kbuagisu-Bijyeo-8B-Think", "x", "T"),
]


def test_relations_with_misspellings(spark):
    rel = spark.createDataFrame(RELS, REL).selectExpr("*", "1 as head", "2 as b1")
    got = {tuple(r) for r in H.found(sources(spark, []), rel).collect()}
    assert {tuple(r) for r in H.found(sources(spark, []), rel, by_load=True).collect()} == got
    assert got == {("relation", "r1", "r2"), ("relation", "r1", "r3"), ("relation", "r1", "r6"), ("relation", "ra", "rb")}


def test_batches_one_by_one_give_the_same(spark):
    rel = spark.createDataFrame(RELS, REL)
    h, got = H.History(spark), set()
    for load in range(5):
        new = h.ingest_relations(rel.where(f"load_no = {load}"))
        if load:
            got |= {tuple(r) for r in new.collect()}
    assert got == {("r1", "r2"), ("r1", "r3"), ("r1", "r6"), ("ra", "rb")}


def test_a_history_outlives_its_session(spark, tmp_path):
    """Load 0 goes in through one session; another takes the folder up, learns nothing anew, and reads only the
    directories its keys fall in."""
    path = f"file://{tmp_path}/history"
    base = [(f"r{i:04d}", 0, f"org/Kubagisu{chr(97 + i % 26)}{chr(97 + i // 26)}lomateru-8B", "x", f"T{i}") for i in range(60)]
    src = [(f"s{i:02d}", 0, f"{i:063x}b", None, "1") for i in range(40)]
    one = H.History(spark, path, buckets=16)
    assert one.ingest_relations(spark.createDataFrame(base, REL)).count() == 0 and one.ingest_sources(sources(spark, src)).count() == 0
    assert one.weights is not None
    other = spark.newSession()
    two = H.History(other, path)
    assert two.buckets == 16 and two.weights == one.weights
    typo = base[7][2].replace("lomateru", "lomaeru")
    batch = other.createDataFrame([("r9000", 1, typo, "x", "T7"), ("r9001", 1, base[9][2].upper(), "x", "t9")], REL)
    keys = two.stage.write(H.relation_rows(batch).select("b1", "b2").distinct(), "keys")
    (read,) = two.probe(["classes"], keys, ["b1", "b2"])
    hit = {r.b for r in keys.selectExpr("pmod(b1, 16) as b").collect()}
    plan = read._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    read_only = re.search(r"PartitionFilters: \[.*?bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert {int(x) for x in (read_only[1] or read_only[2]).split(",")} == hit and len(hit) <= 2 and read.count() == 2
    assert {tuple(r) for r in two.ingest_relations(batch).collect()} == {("r0007", "r9000"), ("r0009", "r9001")}
    assert {tuple(r) for r in two.ingest_sources(sources(other, [("s99", 1, "SHA256:" + src[3][2].upper(), None, "2")])).collect()} == {("s03", "s99")}
    two.compact()
    three = H.History(spark, path)
    again = spark.createDataFrame([("r9500", 2, typo, "x", "T7")], REL)
    assert {tuple(r) for r in three.ingest_relations(again).collect()} == {("r0007", "r9500")}
    assert three.read("classes").groupBy("b1", "b2", "head").count().where("count > 1").count() == 1  # the class of the last batch


def test_edits_brute():
    assert [H.edits("abc", x) for x in ("abc", "acb", "ab", "abcd", "axc", "")] == [0, 1, 1, 1, 1, 3]


def test_neighbours_meet(spark):
    import random

    rng = random.Random(1)
    pairs = []
    for _ in range(60):
        w = "".join(rng.choice("abcdefgh") for _ in range(14))
        pairs.append((w, H.misspell(rng, w[:8]) + H.misspell(rng, w[8:])))
    df = spark.createDataFrame(pairs, "a string, b string").select(F.arrays_overlap(H.neighbours(F.col("a")), H.neighbours(F.col("b"))).alias("m"))
    assert all(r.m for r in df.collect())
