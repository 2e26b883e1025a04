"""Check new batches against everything accepted so far, without reading all of it again.

Method: incremental record linkage.  What is known is kept in tables below one folder, which outlive
the process, in directories by a hash of the blocking key:

* ``source_keys``: digest or address to the first source that has it;
* ``classes``: (block, head) of a relation's writing to its first row and number of rows;
* ``reps``: (block, head) to the representative of the cluster it belongs to, the mapping of a
  union-find whose unions are only ever appended (the smallest entry holds);
* ``weights``: of the pair score, learned once, so a pair's fate doesn't depend on its batch.

A batch probes these tables by key: only directories a key of the batch falls in are read, and what is
read is reduced to the batch's keys by a semi-join before anything is grouped or moved.  Sources link by equal digest or address.  Relations with equal
canonical writing share a class; for a class new to the history the other classes of its block are
fetched, candidates share a deletion neighbour of the first or last letters, and are scored on
the learned weights.  Only blocks with a new class are looked at and only clusters that gain a link
change.  A batch appends what is new; :meth:`History.compact` merges the parts of each directory.

A block is (relation, object, organisation, size/stage/date part of the subject), so another size,
stage or date is never a candidate; the head is the subject's name words.  Hot objects spread over
their subjects' blocks, and rows of one class, however many, are one candidate.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from edgewright.llm import canon, copies
from edgewright.operators.skew import meet
from edgewright.runtime import Stage, folders_in, small

#: Query parameters that only track a visit.
TRACKING = r"utm_.*|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|ttclid|igshid|mc_[ce]id|_ga|_gl|_hsenc|_hsmi|spm|ref|ref_src|referrer|referer|cmpid|campaign|phpsessid|jsessionid|sessionid"
#: Digests of empty content (SHA-256, SHA-1, MD5).
EMPTY_DIGESTS = ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "d41d8cd98f00b204e9800998ecf8427e")
#: Last name words that tell a stage or use; split off where no digit precedes them.
STAGE_WORDS = "base|sft|dpo|rlhf|rlvr|instruct|chat|think|thinking|reasoning|reward|rm|preview|mix|corpus|prompts|pairs|bench|synth|traces|annealing|pretrain|midtrain|embed|embedding|tokenizer|onnx|gguf|awq|fp8|bf16|fp16|int4|int8"
WINDOW = 8
FIT_HEADS = 2000
#: Fewer heads teach nothing.
LEAST_HEADS = 20
#: Directories of a table of a new history.
BUCKETS = 16
#: Most keys of a batch that are sent to the scan of the history; beyond, both sides meet in a shuffle.
PROBE_ROWS = 500_000


def digest(c: Column) -> Column:
    """The bare hexadecimal digest; null if the value is none or names empty content."""
    bare = F.regexp_replace(F.lower(c), r"(?U)^[\s\"'<\x{200B}]*(?:(?:sha-?(?:1|224|256|384|512)|md5|blake[23][bs]?)\s*[:=_-]\s*|0x)?|[\s\"'>\x{200B}]+$", "")
    real = bare.rlike("^[0-9a-f]{32,128}$") & ~bare.rlike(r"^(.)\1*$") & ~bare.isin(*EMPTY_DIGESTS)
    return F.when(real, bare)


_UNRESERVED = re.compile(r"%(2[dDeE]|5[fF]|7[eE]|3[0-9]|[46][1-9a-fA-F]|[57][0-9aA])")


@F.pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(lambda u: _UNRESERVED.sub(lambda m: unquote(m.group()), u), na_action="ignore")


def address(c: Column) -> Column:
    """A URL without what doesn't select the content: scheme, user, www, default port, case of the
    host, fragment, doubled or final slashes, tracking parameters and parameter order, escapes of
    characters that need none.  Null for what is no URL with a host."""
    text = F.regexp_replace(c, r"(?U)^[\s<\"'\x{200B}]+|[\s>\"'\x{200B}]+$", "")
    plain = F.coalesce(_decode(F.when(text.contains("%"), text)), text)
    cut = F.regexp_replace(plain, "#.*$", "")
    part = lambda i: F.regexp_extract(cut, r"^(?i:https?:)?//(?:[^/?@]*@)?([^/?:]+)(?::(\d*))?([^?]*)(?:\?(.*))?$", i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\d*\.|\.$", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(F.regexp_replace(part(3), "/{2,}|/(?:\\./)+", "/"), r"/(?:index\.(?:html?|php))?$", "")
    kept = F.filter(F.split(part(4), "[&;]"), lambda q: (q != "") & ~F.lower(q).rlike(f"^(?:{TRACKING})(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    named = host.rlike(r"^[^\s.]+\.[^\s]+$") | host.rlike(r"^\[?[0-9a-f:]+\]?$")
    return F.when(named, F.concat_ws("", host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def source_rows(sources: DataFrame) -> DataFrame:
    """``id, load_no, at, key``: one row per source and value that identifies it.  A source delivered
    again under its id counts once, with its earliest load."""
    one = sources.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.struct(F.coalesce("load_no", F.lit(0)).alias("load_no"), F.coalesce("created_at", F.lit("")).alias("at"), "content_hash", "canonical_url")).alias("m"))
    h, u = digest(F.col("m.content_hash")), address(F.col("m.canonical_url"))
    keys = F.filter(F.array(F.concat(F.lit("h:"), h), F.concat(F.lit("u:"), u)), lambda k: k.isNotNull())
    return one.select("id", "m.load_no", "m.at", F.explode(keys).alias("key"))


def relation_rows(relations: DataFrame) -> DataFrame:
    """``rel_id, load_no, b1, b2, head``: block fingerprint and name words of each row that states a
    subject and an object.  The same row delivered twice appears twice."""
    p = copies.stated(relations).select(F.col("rel_id").cast("string").alias("rel_id"), F.coalesce("load_no", F.lit(0)).alias("load_no"), copies.label(F.col("relation")).alias("relation"), canon.prepared(F.col("subject")).alias("s"), canon.canonical(canon.prepared(F.col("object"))).alias("o"))
    p = p.withColumn("org", F.when(F.col("s").contains("/"), canon.letters(F.substring_index("s", "/", 1))).otherwise("")).withColumn("rest", F.regexp_replace("s", "^[^/]*/", ""))
    outside, facets = canon.parts(F.col("rest"))
    p = p.select("rel_id", "load_no", "relation", "o", "org", outside.alias("name"), F.when(F.col("rest").contains("["), facets).otherwise("").alias("facets"))
    head = F.regexp_extract("name", "^[^\\p{N}]*", 0)
    bare_stage = F.when(head == F.col("name"), F.regexp_extract("name", f"(?<=.{{4}})(?:{STAGE_WORDS})$", 0)).otherwise("")
    p = p.withColumn("head", F.substring("name", F.lit(1), F.length(head) - F.length(bare_stage)))
    tail = F.concat_ws(copies.SEP, F.expr("substring(name, length(head) + 1)"), "facets")
    p = p.withColumn("block", F.concat_ws(copies.SEP, "relation", "o", "org", tail))
    return p.select("rel_id", "load_no", F.xxhash64("block").alias("b1"), F.xxhash64(F.lit("block"), "block").alias("b2"), "head")


def neighbours(head: Column) -> Column:
    """Blocking keys of a head: its first letters with each one left out, and its last ones.

    Two heads share one whenever one window holds at most one misspelling (a letter more, less,
    other, or two swapped), however many the rest has.  Short heads give their whole text's.
    """
    first, last = F.substring(head, 1, WINDOW), F.substring(head, -WINDOW, WINDOW)
    without = lambda s, mark: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(WINDOW))))
    return F.array_distinct(F.concat(without(first, "<"), without(last, ">"), F.array(F.concat(F.lit("<"), F.substring(head, 1, WINDOW - 1)), F.concat(F.lit(">"), F.substring(head, 1 - WINDOW, WINDOW - 1)))))


def edits(a: str, b: str) -> int:
    """Letters added, left out, changed, or neighbours swapped, that turn a into b."""
    before, line = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = line[j - 1] if x == y else 1 + min(line[j - 1], line[j], new[j - 1])
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            new.append(v)
        before, line = line, new
    return line[-1]


def features(a: str, b: str) -> list[float]:
    d, n = edits(a, b), max(len(a), len(b), 1)
    ga, gb = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return [1.0, float(d), d / n, 2 * len(ga & gb) / max(1, len(ga) + len(gb)), float(a[:1] != b[:1]), float(abs(len(a) - len(b)))]


def misspell(rng: random.Random, s: str) -> str:
    i = rng.randrange(max(1, len(s) - 1))
    kind = rng.randrange(4)
    if kind == 0:
        return s[:i] + s[i + 1 :]
    if kind == 1:
        return s[:i] + s[i : i + 1] + s[i:]
    if kind == 2:
        return s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :]
    return s[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + s[i + 1 :]


def learn_weights(heads: list[str], seed: int = 7) -> np.ndarray:
    """Logistic weights on :func:`features`, from misspelt heads against other heads and heads that
    share one half; without enough heads, weights that accept up to 3 edits of at most a quarter."""
    heads = sorted({h for h in heads if len(h) >= 6})
    if len(heads) < LEAST_HEADS:
        return np.array([4.0, -1.0, -2.0, 0.0, 0.0, 0.0])
    rng = random.Random(seed)
    x, y = [], []
    for h in heads:
        half = len(h) // 2
        typo = lambda s: misspell(rng, s[:half]) + (misspell(rng, s[half:]) if rng.random() < 0.5 else s[half:])
        x.append(features(h, typo(h)))
        x.append(features(typo(h), typo(h)))
        o = rng.choice(heads)
        x.append(features(h, o))
        mixed = h[:half] + o[len(o) // 2 :] if rng.random() < 0.5 else o[: len(o) // 2] + h[half:]
        x.append(features(h, mixed))
        y += [1.0, 1.0, float(o == h), float(edits(mixed, h) <= 1)]
    a, t = np.array(x), np.array(y)
    scale = np.abs(a).max(axis=0) + 1e-9
    a, w = a / scale, np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (t - p) - 1e-2 * w)
    return w / scale


def _linker(weights: list[float]):
    w = np.array(weights)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key, best supported head first; each head is compared with the hubs
        of its key, so a crowd of misspellings costs heads times hubs, not all pairs."""
        at, hubs, out = None, [], []
        for b in batches:
            for b1, b2, key, head in zip(b["b1"].tolist(), b["b2"].tolist(), b["key"].tolist(), b["head"].tolist()):
                if (b1, b2, key) != at:
                    at, hubs = (b1, b2, key), [head]
                    continue
                for hub in hubs:
                    if hub == head or float(np.dot(w, features(hub, head))) > 0:
                        if hub != head:
                            out.append((b1, b2, head, hub))
                        break
                else:
                    hubs.append(head)
            yield pd.DataFrame(out, columns=["b1", "b2", "head", "hub"])
            out = []

    return link


_FIRST = "first struct<load_no:int,rel_id:string>"
TABLES = {
    "source_keys": "k1 long, k2 long, first struct<load_no:int,at:string,id:string>, bucket int",
    "classes": f"b1 long, b2 long, head string, {_FIRST}, n long, bucket int",
    "reps": f"b1 long, b2 long, head string, rep struct<{_FIRST.replace(' ', ':', 1)},head:string>, bucket int",
}
_AT = ["b1", "b2", "head"]


class History:
    """Persisted blocking tables below ``path``; :meth:`ingest_sources` and :meth:`ingest_relations` take a
    batch and give its links.  An existing folder is taken up where it was left, by any session."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.stage = Stage(spark, "history")
        self.path = (path or f"{self.stage.root}/tables").rstrip("/")
        there = set(folders_in(spark, self.path))
        if "made" in there:
            buckets = self.spark.read.schema("buckets int").parquet(f"{self.path}/made").first().buckets
        else:
            spark.range(1).selectExpr(f"{buckets} as buckets").coalesce(1).write.parquet(f"{self.path}/made")
        self.buckets = buckets
        self.weights: list[float] | None = None
        if "weights" in there:
            self.weights = [r.w for r in spark.read.schema("i int, w double").parquet(f"{self.path}/weights").orderBy("i").collect()]
        self.versions = {name: max((int(v[1:]) for v in folders_in(spark, f"{self.path}/{name}", "_SUCCESS")), default=0) if name in there else 0 for name in TABLES}

    def _append(self, name: str, df: DataFrame) -> None:
        """Adds rows to the directories of a table; the files before are not touched."""
        self.versions[name] = max(1, self.versions[name])
        at = f"{self.path}/{name}/v{self.versions[name]}"
        cols = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", TABLES[name])]
        df.select(*cols).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(at)

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.col(c), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or only some of its directories; None before the first batch."""
        version = self.versions[name]
        if not version:
            return None
        t = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/v{version}")
        return t if buckets is None else t.where(F.col("bucket").isin(buckets))

    def probe(self, names: list[str], keys: DataFrame, on: list[str]) -> list[DataFrame | None]:
        """For each table its rows that meet ``keys`` (staged, distinct on ``on``), from the directories a key falls in."""
        if not any(self.versions[n] for n in names):
            return [None] * len(names)
        hit = [r.bucket for r in keys.select(self._bucket(on[0]).alias("bucket")).distinct().collect()]  # at most one per directory
        keys = F.broadcast(keys.select(*on)) if small(keys, PROBE_ROWS) else keys.select(*on)
        return [t if (t := self.read(n, sorted(hit))) is None else t.join(keys, on, "left_semi").drop("bucket") for n in names]

    def compact(self) -> None:
        """Rewrites each table with one row per key as a new version, then drops the version before."""
        rules = {"source_keys": (["k1", "k2"], [F.min("first").alias("first")]), "classes": (_AT, [F.min("first").alias("first"), F.sum("n").alias("n")]), "reps": (_AT, [F.min("rep").alias("rep")])}
        for name, (keys, aggs) in rules.items():
            version = self.versions[name]
            if version:
                whole = self.read(name).groupBy("bucket", *keys).agg(*aggs)
                whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/v{version + 1}")
                self.versions[name] = version + 1
                self.stage.drop_path(f"{self.path}/{name}/v{version}")

    # -- sources -----------------------------------------------------------------------------
    def ingest_sources(self, batch: DataFrame) -> DataFrame:
        """``key_a, key_b``: each source of the batch that has the digest or the address of an
        earlier one, with the first of those.  Order: load, creation time, id."""
        on = ["k1", "k2"]
        rows = source_rows(batch).select("id", "load_no", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("key"), "key").alias("k2"))
        rows = self.stage.write(rows, "batch-keys")
        firsts = rows.groupBy(*on).agg(F.min(F.struct("load_no", "at", "id")).alias("first"), F.count("*").alias("n"))
        firsts = self.stage.write(firsts, "firsts")
        (old,) = self.probe(["source_keys"], firsts, on)
        if old is None:
            fresh = firsts
        else:
            old = old.groupBy(*on).agg(F.min("first").alias("old"))
            both = firsts.join(old, on, "left").select(*on, F.least("first", "old").alias("first"), "n", F.col("old").isNotNull().alias("known"))
            firsts = self.stage.write(both, "firsts")
            fresh = firsts.where("not known")
        self._append("source_keys", fresh.select(*on, "first", self._bucket("k1").alias("bucket")))
        repeated = firsts.where("n > 1" if old is None else "n > 1 or known").select(*on, "first", "n")
        best = meet(rows, repeated, on, "n", rows.count()).groupBy("id").agg(F.min("first").alias("first")).where("first.id <> id")
        return best.select(F.least("first.id", "id").alias("key_a"), F.greatest("first.id", "id").alias("key_b"))

    # -- relations ---------------------------------------------------------------------------
    def ingest_relations(self, batch: DataFrame) -> DataFrame:
        """``key_a, key_b``: each row of the batch whose edge was stated before, or with misspelt
        words in the subject, with the first row of its cluster.  Order: load, rel_id."""
        block = ["b1", "b2"]
        rows = self.stage.write(relation_rows(batch), "batch-rows")
        new = self.stage.write(rows.groupBy(*_AT).agg(F.min(F.struct("load_no", "rel_id")).alias("first"), F.count("*").alias("n")), "batch-classes")
        blocks = self.stage.write(new.select(*block).distinct(), "blocks")
        before, reps = self.probe(["classes", "reps"], blocks, block)
        if before is None:
            new = new.withColumn("known", F.lit(False))
        else:
            before = self.stage.write(before.groupBy(*_AT).agg(F.min("first").alias("old"), F.sum("n").alias("old_n")), "before")
            new = new.join(before, _AT, "left").select(*_AT, F.least("first", "old").alias("first"), "n", F.col("old").isNotNull().alias("known"))
            new = self.stage.write(new, "batch-classes")
        if reps is not None:
            reps = self.stage.write(reps.groupBy(*_AT).agg(F.min("rep").alias("known_rep")), "reps")
        linked = self._link(new, before, reps)
        self._append("classes", new.select(*_AT, "first", "n", self._bucket("b1").alias("bucket")))
        told = new.select(*_AT, "first", "n", "known")
        if linked is not None:
            self._append("reps", linked.select(*_AT, "rep", self._bucket("b1").alias("bucket")))
            told = told.join(linked.select(*_AT, F.col("rep.first").alias("r1")), _AT, "left")
        if reps is not None:
            told = told.join(reps.select(*_AT, F.col("known_rep.first").alias("r2")), _AT, "left")
        found = [c for c in ("r1", "r2") if c in told.columns]
        least = F.least("first", *found) if found else F.col("first")
        changed = told.where(" or ".join(["n > 1", "known", *(f"{c} is not null" for c in found)])).select(*_AT, least.alias("first"), "n")
        met = meet(rows, self.stage.write(changed, "changed"), _AT, "n", rows.count())
        best = met.where("first.rel_id <> rel_id").groupBy("rel_id").agg(F.min("first").alias("first"))
        return best.select(F.least("first.rel_id", "rel_id").alias("key_a"), F.greatest("first.rel_id", "rel_id").alias("key_b"))

    def _pair_weights(self, new: DataFrame) -> list[float]:
        """The stored weights, else weights learned on at most ``FIT_HEADS`` heads of this batch; they are
        stored as soon as there were enough heads."""
        if self.weights is None:
            sample = [r.head for r in new.select("head").orderBy(F.xxhash64("head"), "head").limit(FIT_HEADS).collect()]
            learned = learn_weights(sample).tolist()
            if len({h for h in sample if len(h) >= 6}) < LEAST_HEADS:
                return learned
            self.weights = learned
            self.spark.createDataFrame(list(enumerate(learned)), "i int, w double").coalesce(1).write.parquet(f"{self.path}/weights")
        return self.weights

    def _link(self, new: DataFrame, before: DataFrame | None, reps: DataFrame | None) -> DataFrame | None:
        """``b1, b2, head, rep`` of each class that a link joins to another: union-find by the least
        neighbour and the representative of the representative, restarted from those known so far."""
        weights = self._pair_weights(new)
        fresh = new.where("not known").select("b1", "b2").distinct()
        pool = new.select(*_AT, "first", "n")
        if before is not None:
            pool = pool.unionByName(before.join(fresh, ["b1", "b2"], "left_semi").select(*_AT, F.col("old").alias("first"), F.col("old_n").alias("n")))
        pool = pool.groupBy(*_AT).agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("head <> ''")
        crowded = pool.groupBy("b1", "b2").agg(F.count("*").alias("heads")).where("heads > 1").select("b1", "b2")
        pool = self.stage.write(pool.join(crowded, ["b1", "b2"], "left_semi"), "pool")
        if pool.isEmpty():
            return None
        keyed = pool.select(*_AT, "n", F.explode(neighbours(F.col("head"))).alias("key"))
        keyed = keyed.repartition("b1", "b2", "key").sortWithinPartitions("b1", "b2", "key", F.desc("n"), "head")
        found = keyed.select("b1", "b2", "key", "head").mapInPandas(_linker(weights), "b1 long, b2 long, head string, hub string")
        links = self.stage.write(found.distinct(), "links")
        if links.isEmpty():
            return None
        ends = links.select(*_AT, F.col("hub").alias("other")).unionByName(links.select("b1", "b2", F.col("hub").alias("head"), F.col("head").alias("other")))
        label = pool.join(ends.select(*_AT).distinct(), _AT).select(*_AT, F.struct("first", "head").alias("rep"))
        if reps is not None:
            label = label.join(reps, _AT, "left").select(*_AT, F.least("rep", "known_rep").alias("rep"))
        label = self.stage.write(label, "labels")
        while True:
            told = ends.join(label.select("b1", "b2", F.col("head").alias("other"), "rep"), ["b1", "b2", "other"]).groupBy(*_AT).agg(F.min("rep").alias("told"))
            nearer = label.join(told, _AT).select(*_AT, F.col("rep").alias("was"), F.least("rep", "told").alias("rep"))
            jump = label.select("b1", "b2", F.col("head").alias("to"), F.col("rep").alias("far"))
            moved = nearer.withColumn("to", F.col("rep.head")).join(jump, ["b1", "b2", "to"], "left").select(*_AT, F.least("rep", "far").alias("rep"), "was")
            new_label = self.stage.write(moved.select(*_AT, "rep", (F.col("rep") < F.col("was")).alias("moved")), "labels")
            self.stage.drop(label)
            label, again = new_label.drop("moved"), not new_label.where("moved").isEmpty()
            label._edgewright_path = new_label._edgewright_path
            if not again:
                return label


def _load() -> Column:
    """The load of a row; null and anything below 0 is history."""
    return F.greatest(F.coalesce("load_no", F.lit(0)), F.lit(0))


def found(sources: DataFrame, relations: DataFrame, path: str | None = None, by_load: bool = False) -> DataFrame:
    """``record_kind, key_a, key_b`` of each later row that repeats an accepted one: the history
    (load 0) is taken in first, then the later loads as one batch or, ``by_load``, each as a batch of
    its own, in order.

    Nulls identify nothing; a null load_no counts as history; ties go to the smaller key; repeats
    of a delivery count once; empty tables give no pairs; other columns are ignored.  A source delivered in
    several loads under one id counts in the earliest.  ``path``: where the history is to be kept; by default it goes with the staged tables.
    """
    h = History(relations.sparkSession, path)
    one = h.stage.write(sources.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.struct(_load().alias("load_no"), F.coalesce("created_at", F.lit("")).alias("created_at"), "content_hash", "canonical_url")).alias("m")).select("id", "m.*"), "sources")

    def one_by_one(kind: str, rows: DataFrame, ingest) -> list[DataFrame]:
        no = _load() if by_load else F.least(_load(), F.lit(1))
        pairs = []
        for batch in sorted(r.no for r in rows.select(no.alias("no")).distinct().collect()):
            links = ingest(rows.where(no == batch))
            if batch:
                links = links.select(F.lit(kind).alias("record_kind"), "key_a", "key_b")
                pairs.append(h.stage.write(links, "links-of-batch") if by_load else links)
        return pairs

    with ThreadPoolExecutor(2) as both:  # the two kinds of records don't touch each other's tables
        jobs = [both.submit(one_by_one, "source", one, h.ingest_sources), both.submit(one_by_one, "relation", relations, h.ingest_relations)]
        pairs = [df for job in jobs for df in job.result()]
    out = relations.sparkSession.createDataFrame([], "record_kind string, key_a string, key_b string")
    for p in pairs:
        out = out.unionByName(p)
    return out.distinct() if by_load else out
