"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship  # noqa: F401 - for the operators

#: White space of the word rule: a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session in local mode that names none (as in tests) gets a temporary folder; a cluster must
    name one, as a folder of the driver's machine would not be shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these settings for a while, and then its own again."""
    own = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """Intermediate tables in the shared folder.

    ``keep`` writes a frame once and reads it back, which cuts the lineage and survives the loss
    of executors; ``values`` are settings that hold for this. ``drop`` deletes a table as soon as
    nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str, values: dict[str, str] | None = None) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.values = values or {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with settings(self.spark, self.values):
            frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, not at some later collection."""
        for _ in range(2):  # the second collection meets what the first one has let go
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            with contextlib.suppress(Exception):  # a table that stays behind costs disk only
                path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
