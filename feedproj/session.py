"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "feedproj", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings below; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.ui.enabled": "false",
        # Skips recording a Python call site for every Column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on, for sessions made elsewhere.

    Every timestamp in the feed is a UTC instant, so the session must render UTC.
    A skewed join is split even where a later step then needs one more shuffle:
    otherwise a group-by on the join key keeps a hot key in one task. Times are written
    with statistics (the default parquet type for them has none), so filters on time skip.
    """
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"),
        ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true"),
    ):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A private folder is made only in local mode with the setting absent (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="feedproj-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as a table and read it from there.

    Used where one result feeds several outputs, or where a loop would grow the
    plan. Survives the loss of executors, unlike a cached or local copy, and its
    readers still prune columns and know its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go when it ends, not when the driver happens to collect garbage.

    For writes whose frame nobody runs again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Staging:
    """``checkpointed`` that remembers its tables, so a long-running feed can drop them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/staged/{uuid.uuid4().hex}"
        self._n = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the staged tables; frames read from them must not be used any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
