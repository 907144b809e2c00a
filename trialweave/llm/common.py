"""Tables, shared files and small helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Words are runs of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only below this many rows, counted first; beyond it Spark shuffles both.
BROADCAST_ROWS = 20_000

_own_dir: list[str] = []


#: Session setting for the bytes of an Arrow batch, its default, and ours: texts are worked on in smaller blocks anyway.
_BATCH, _DEFAULT, _OURS = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB"), "2m"


def prepare(spark: SparkSession) -> None:
    """Ships the package and, unless the session has a size of its own, keeps Arrow batches of texts small."""
    ship(spark)
    if spark.conf.get(_BATCH) in _DEFAULT:
        spark.conf.set(_BATCH, _OURS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir, or (unset, in local mode only) one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub(r"^file:/(?!//)", "file:///", full).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="trialweave-"))
    return _own_dir[0]


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor.

    ``keep`` writes a frame and returns the reader of it; ``drop`` deletes what no later step reads. What is
    left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        prepare(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
        files, path = self._at(self.path)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _at(self, path: str):
        """A file system and a path of it, in the driver's JVM."""
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(context._jsc.hadoopConfiguration()), found

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of steps that are kept, which it does only after the driver has collected its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = self._at(f"{self.path}/{name}")
            files.delete(path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most so many rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Joins, broadcasting the right side only if its counted size is small."""
    return left.join(F.broadcast(right) if is_small(right) else right, on, how)


def words(text) -> F.Column:
    """The words of a text column as an array; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
