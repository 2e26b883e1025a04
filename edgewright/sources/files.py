"""Graph documents, event and verdict logs, and content-addressed files as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = "array<string>"
_ITEM = "struct<kind:string,formal_name:string,identity:map<string,string>,aliases:array<string>,links:array<struct<kind:string,url:string>>,description:string,subsets:array<string>>"
_EDGE = "struct<subject:string,relation:string,dependency_kind:string,object:string,description:string,anchor_list:array<string>>"
ANCHOR = "struct<source:string,position:string,excerpt:string,explanation:string>"
VERDICT = "cluster_key string, target string, subject string, object string, systems array<string>, verdict string, confidence double, explanation string"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def _list(doc: str, *paths: str):
    """The first of the JSON paths that is there, as a list of texts, one per element."""
    return F.from_json(F.coalesce(*(F.get_json_object(doc, p) for p in paths), F.lit("[]")), _TEXTS)


def endpoint_name(c):
    """An endpoint's name: ``formal_name``, else ``name`` of an object, else the text itself."""
    return F.when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.formal_name"), F.get_json_object(c, "$.name"), c)).otherwise(c)


def _anchors(c):
    """Elements that are no objects are left out, the others keep their place."""
    return F.transform(F.filter(c, lambda a: a.startswith("{")), lambda a: F.from_json(a, ANCHOR))


def read_graph_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of graph or lattice documents (``lattice.groups`` or ``groups``), with ordinals of group and item."""
    groups = _documents(spark, path).select("file", F.posexplode(_list("doc", "$.lattice.groups", "$.groups")).alias("group_ord", "g"))
    items = groups.select("file", "group_ord", F.get_json_object("g", "$.family").alias("family"), F.posexplode(_list("g", "$.items")).alias("item_ord", "i"))
    parsed = items.withColumn("i", F.from_json("i", _ITEM)).where("i is not null")
    facets = F.array_sort(F.transform(F.map_entries("i.identity"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return parsed.select("file", "group_ord", "item_ord", "family", "i.kind", "i.formal_name", facets.alias("identity"), "i.aliases", "i.links", "i.description", "i.subsets")


def read_graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """Relations of graph documents (``relations`` or ``edges``); endpoints may be objects, faulty anchors
    are left out one by one."""
    e = _documents(spark, path).select("file", F.posexplode(_list("doc", "$.relations", "$.edges")).alias("ord", "e")).withColumn("e", F.from_json("e", _EDGE)).where("e is not null")
    return e.select("file", "ord", endpoint_name(F.col("e.subject")).alias("subject"), "e.relation", "e.dependency_kind", endpoint_name(F.col("e.object")).alias("object"), "e.description", _anchors(F.col("e.anchor_list")).alias("anchor_list"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Edges of an operation log, one JSON operation per line, with the operation's line number, place, and
    description.  Blank lines are skipped; a line that is no JSON object raises with its number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where("trim(line) <> ''")
    ok = F.trim("line").startswith("{") & F.try_parse_json(F.col("line")).isNotNull()
    checked = lines.withColumn("line", F.when(ok, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no JSON object in line "), F.col("n") + 1))))
    edges = checked.select((F.col("n") + 1).alias("line_no"), F.get_json_object("line", "$.description").alias("event_description"), F.posexplode(_list("line", "$.edges")).alias("edge_ord", "e")).withColumn("e", F.from_json("e", _EDGE))
    return edges.where("e is not null").select("line_no", "edge_ord", "event_description", endpoint_name(F.col("e.subject")).alias("subject"), "e.relation", "e.dependency_kind", endpoint_name(F.col("e.object")).alias("object"), "e.description", _anchors(F.col("e.anchor_list")).alias("anchor_list"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Stored verdicts; lines that are no JSON are left out."""
    return spark.read.schema(VERDICT).option("mode", "DROPMALFORMED").json(path).where("cluster_key is not null")


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("append").json(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """Edges as JSON lines, null fields left out."""
    edges.write.mode("overwrite").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256, n_bytes`` of every file below a folder, hidden ones left out."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes")).where("file not rlike '/[.][^/]*$'")


def folder_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row: SHA-256 over the sorted relative paths and hashes of a folder."""
    rel = F.regexp_replace("file", "^.*" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    line = F.concat(rel, F.lit("\0"), F.col("sha256"), F.lit("\0"))
    return file_hashes(spark, path).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("fingerprint"), F.count("*").alias("n_files"))


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, turns, tool_calls, tools, final_text, cost_usd, input_tokens, output_tokens`` of logs of one JSON record per line:
    turns and tool calls of assistant records, the last text, cost and tokens of the last result record that gives them.

    Lines that are no JSON objects are left out.  The place of a line is its offset in its file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    shape = "type string, total_cost_usd double, usage struct<input_tokens:bigint,output_tokens:bigint>, message struct<content:array<struct<type:string,name:string,text:string>>>"
    r = lines.withColumn("r", F.from_json("value", shape)).where("r.type is not null")
    parts = F.coalesce("r.message.content", F.array().cast("array<struct<type:string,name:string,text:string>>"))
    said = F.col("r.type") == "assistant"
    tools = F.transform(F.filter(parts, lambda p: p["type"] == "tool_use"), lambda p: F.coalesce(p["name"], F.lit("tool_use")))
    text = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (p["text"] != "")), lambda p: p["text"])), -1)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("at")))
    row = r.select("file", "at", said.alias("said"), F.when(said, tools).alias("tools"), F.when(said, text).alias("text"), F.col("r.total_cost_usd").alias("cost"), F.col("r.usage.input_tokens").alias("i"), F.col("r.usage.output_tokens").alias("o"))
    return row.groupBy("file").agg(
        F.sum(F.col("said").cast("long")).alias("turns"), F.sum(F.coalesce(F.size("tools"), F.lit(0))).alias("tool_calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools"), last(F.col("text")).alias("final_text"),
        F.coalesce(last(F.col("cost")), F.lit(0.0)).alias("cost_usd"), F.coalesce(last(F.col("i")), F.lit(0)).alias("input_tokens"), F.coalesce(last(F.col("o")), F.lit(0)).alias("output_tokens"),
    )


def rate_limited(spark: SparkSession, path: str, needles: tuple[str, ...]) -> bool:
    """Whether a line of the logs holds one of ``needles`` in any case."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.lower("value").contains(n.lower())
    return not spark.read.text(path).where(hit).isEmpty()
