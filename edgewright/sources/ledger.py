"""Content-addressed source ledger, batches, run log and name packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Content types by suffix.
CONTENT_TYPES = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "json": "application/json", "pdf": "application/pdf", "yaml": "application/yaml", "yml": "application/yaml", "py": "text/x-python"}


def url_ledger(sources: DataFrame) -> DataFrame:
    """First and last time each source's URL was seen."""
    return sources.where("canonical_url is not null").groupBy("id", F.col("canonical_url").alias("url")).agg(F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"))


def content_ledger(sources: DataFrame) -> DataFrame:
    """One row per content hash as written: its first source by load and id, and how many share it."""
    s = sources.where("content_hash is not null").dropDuplicates(["id"])
    return s.groupBy("content_hash").agg(F.min(F.struct("load_no", "id")).alias("f"), F.count("*").alias("n_sources")).select("content_hash", F.col("f.id").alias("id"), "n_sources")


def batch_fingerprints(sources: DataFrame) -> DataFrame:
    """SHA-256 over the sorted ``id:hash`` of each load.

    The sorted list of a batch is one value by definition; a batch is what one delivery registers.
    """
    line = F.concat("id", F.lit(":"), F.coalesce("content_hash", F.lit("")))
    return sources.groupBy("load_no").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "|"), 256).alias("fingerprint"), F.countDistinct("id").alias("n_sources"))


def content_type(c):
    """Content type by file suffix."""
    suffix = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in CONTENT_TYPES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def names_packet(relations: DataFrame) -> DataFrame:
    """Distinct (kind, name): endpoints by the side they stand on, in order."""
    s = relations.select(F.lit("subject").alias("kind"), F.trim("subject").alias("name")).unionByName(relations.select(F.lit("object").alias("kind"), F.trim("object").alias("name")))
    return s.where("name <> ''").distinct()


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last completed run of each stage by start time, the greatest id on ties."""
    done = runs.where("ended_at is not null and started_at is not null")
    return done.groupBy("stage").agg(F.max(F.struct("started_at", "id")).alias("m"), F.countDistinct("id").alias("n_runs")).select("stage", F.col("m.id").alias("id"), F.col("m.started_at").alias("started_at"), "n_runs")


def run_counters(runs: DataFrame) -> DataFrame:
    """Edge counts of the run attributes per stage; attributes that are no JSON count as none."""
    n = F.expr("try_cast(get_json_object(attrs, '$.edge_count') as bigint)")
    return runs.dropDuplicates(["id"]).groupBy("stage").agg(F.count("*").alias("n_runs"), F.sum(n).alias("edges"), F.count(n).alias("with_edges"))


def lattice_search(lattice: DataFrame, needle: str | None = None, most: int = 50, kind: str | None = None, family: str | None = None, linked: bool | None = None) -> DataFrame:
    """Items whose formal name or an alias holds ``needle`` in any case, of a kind, of a family, with or without a link, each
    if given: the first ``most`` by item_id."""
    it = lattice.dropDuplicates(["item_id"])
    if needle is not None:
        low = needle.lower()
        hit = F.lower("formal_name").contains(low) | F.coalesce(F.exists("aliases", lambda a: F.lower(a).contains(low)), F.lit(False))
        it = it.where(F.coalesce(hit, F.lit(False)))
    for c, v in (("kind", kind), ("family", family)):
        it = it if v is None else it.where(F.col(c) == v)
    if linked is not None:
        has = F.coalesce(F.size("links"), F.lit(0)) > 0
        it = it.where(has if linked else ~has)
    return it.orderBy("item_id").limit(most).select("item_id", "family", "kind", "formal_name")


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(frames.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
