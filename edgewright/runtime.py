"""Session helpers: table access, tables staged in the shared folder, lineage cuts.

Iterative operators cut their lineage by writing an intermediate table below the folder the
cluster names in ``spark.checkpoint.dir``.  All executors see that folder, so the loss of an
executor never loses a staged table.  Only in local mode (unit tests) the setting may be absent; then a
private temporary folder is used.  On a cluster its absence is an error.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_STAGED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, else a temporary one, in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="edgewright-")
    return _LOCAL_FALLBACK[app]


class Stage:
    """Tables of one operator run, each written once and read back without its lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = itertools.count(1)
        _STAGED.add(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self._n):03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._edgewright_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Deletes staged tables nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = getattr(df, "_edgewright_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


    def drop_path(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folders_in(spark: SparkSession, path: str, holding: str = "") -> list[str]:
    """Names of the folders in a folder of any file system, of those that hold a file ``holding`` if one is
    named; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    inside = [f.getPath() for f in fs.listStatus(p) if f.isDirectory()]
    return [q.getName() for q in inside if not holding or fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(q, holding))]


def clear_staged(spark: SparkSession) -> None:
    """Deletes all tables this process staged.  Results that still read them must be written first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in sorted(_STAGED):
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    _STAGED.clear()


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than that plus one.

    Guards every broadcast in this library: a side is broadcast only behind this check.
    """
    return df.limit(most_rows + 1).count() <= most_rows
