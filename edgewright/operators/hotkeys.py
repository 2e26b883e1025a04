"""Per-key results where a few keys hold most rows.

Everything is an algebraic native aggregate: each task combines its rows in Spark's bounded hash
table (which spills to sorted runs when it is full), and only one compact state per key and task is
shuffled.  However many rows a key has, a reducer sees at most one state of it per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def endpoint_counts(edges: DataFrame) -> DataFrame:
    """``field_name, key_value, n``: rows of each value, as written, of ``subject`` and ``object``.

    Null and empty values are no keys.  Rows delivered twice count twice.
    """
    long = edges.select(F.explode(F.array(F.struct(F.lit("subject").alias("field_name"), F.col("subject").alias("key_value")), F.struct(F.lit("object").alias("field_name"), F.col("object").alias("key_value")))).alias("e"))
    return long.select("e.field_name", "e.key_value").where("key_value <> ''").groupBy("field_name", "key_value").agg(F.count("*").alias("n"))


def heavy_endpoints(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """``field_name, key_value``: keys that stand in at least ``share`` of all rows of ``edges``.

    The row count is a scalar subquery (one number); the result has at most 2 / share rows.
    An empty table gives no key.
    """
    spark = edges.sparkSession
    return spark.sql(
        "select field_name, key_value from {counts} where n >= {share} * (select count(*) from {edges})",
        counts=endpoint_counts(edges), edges=edges, share=float(share),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """``artifact, out_degree, in_degree, degree, n_relations`` of every non-empty endpoint.

    ``n_relations`` (distinct relation labels) is a distinct aggregate; Spark expands it into a
    partial aggregation on (artifact, relation), so it is mergeable as well.  A null relation is no
    label.
    """
    long = edges.select("relation", F.explode(F.array(F.struct(F.col("subject").alias("artifact"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("artifact"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    per_relation = long.where("e.artifact <> ''").groupBy("e.artifact", "relation").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    return per_relation.groupBy("artifact").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), (F.sum("o") + F.sum("i")).alias("degree"), F.count("relation").alias("n_relations"))
