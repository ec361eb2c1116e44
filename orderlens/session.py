"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Date arithmetic is done on zone-free timestamps, so the zone only matters for
# display. Skew handling stays with adaptive execution: oversized shuffle
# partitions of a sort-merge join are split at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Adaptive execution merges small shuffle partitions but never divides a large one that is not skewed,
# so a session starts with many: 100 TB then come in parts of a few GB at most, after column pruning far less.
SHUFFLE_PARTITIONS = 20_000
LOCAL_SHUFFLE_PARTITIONS = 32


def build_session(app: str = "orderlens", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the library's settings. ``shuffle_partitions`` is the number that shuffles start with, by default
    ``SHUFFLE_PARTITIONS``, on a local master ``LOCAL_SHUFFLE_PARTITIONS``."""
    local = bool(master) and master.startswith("local")
    start = shuffle_partitions or (LOCAL_SHUFFLE_PARTITIONS if local else SHUFFLE_PARTITIONS)
    conf = {"spark.sql.shuffle.partitions": str(start), **conf}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only when the session is local
    and names none. On a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="orderlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


# What this process has written below the shared folder, and saved in the catalog, for each application.
_OWNED: dict[str, tuple[list[str], list[str]]] = {}


def _owned(spark: SparkSession) -> tuple[list[str], list[str]]:
    return _OWNED.setdefault(spark.sparkContext.applicationId, ([], []))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing there is ever overwritten. ``close_scratch`` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/orderlens/{name}-{uuid.uuid4().hex[:12]}"
    _owned(spark)[0].append(path)
    return path


def scratch_table(spark: SparkSession, prefix: str) -> str:
    """A fresh catalog name, which ``close_scratch`` drops."""
    name = f"{prefix}_{uuid.uuid4().hex[:12]}"
    _owned(spark)[1].append(name)
    return name


def close_scratch(spark: SparkSession) -> None:
    """Drop the catalog tables and remove the folders that analyses of this application have written.

    Call it when no result that reads them is needed any more.
    """
    paths, tables = _owned(spark)
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in paths:
        remove_path(spark, path)
    paths.clear(), tables.clear()


class Scratch:
    """Intermediate tables below the shared folder, owned by whoever opened them.

    ``keep`` writes a frame once and goes on from the written table; ``close`` (or the
    end of a ``with`` block) removes everything that was kept, and nothing else.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._kept = spark, scratch_path(spark, name), 0
        self._tables: list[str] = []

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        self._kept += 1
        path = f"{self.path}/{self._kept:03d}-{name}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``keep``, as a table bucketed by a key, so that it meets others on the key without a shuffle.

        Rows stay in the task that made them; a task writes a file for each bucket it has rows of, so it should
        have few keys.
        """
        self._kept += 1
        table = scratch_table(self.spark, name)
        self._tables.append(table)
        df.write.option("compression", "zstd").option("path", f"{self.path}/{self._kept:03d}-{name}").bucketBy(
            buckets, key).saveAsTable(table)
        return self.spark.table(table)

    def remove(self, *frames: DataFrame) -> None:
        """Remove kept tables that nothing reads any more."""
        for path in {f.rsplit("/part-", 1)[0] for df in frames for f in df.inputFiles()}:
            top = path[path.index(self.path.rsplit("/", 1)[1]):].split("/")[:2]
            remove_path(self.spark, f"{self.path.rsplit('/', 1)[0]}/{'/'.join(top)}")

    def close(self) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_path(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that its URI names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once below the shared folder and go on from the written table.

    Unlike a checkpoint it is computed in a single pass, and later readers take only
    the columns they need. It survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
