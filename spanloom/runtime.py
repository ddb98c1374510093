"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def local_session(cpus: int = 8, app: str = "spanloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on.

    All timestamps are read as UTC. AQE splits oversized join partitions even where that costs
    one more exchange, because a session or a parent may own a large share of all rows.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # A union that reports its children's partitioning fails once AQE resizes one of them
    # ("Can't zip RDDs with unequal numbers of partitions", Spark 4.1).
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # The JVM never compiles methods above 8000 bytes; past that Spark splits the stage instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and table names of its own."""
    made = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if made.conf.isModifiable(key):
            made.conf.set(key, value)
    return made


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spanloom-"))
    return _own_dir[0]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably: a lost executor re-reads files instead of re-running the plan, and
    later steps prune columns and see real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counting(df: DataFrame, counted: Column) -> tuple[DataFrame, int]:
    """``settle``, and the number of its rows that satisfy ``counted``, found while they are written."""
    seen = Observation()
    settled = settle(df.observe(seen, F.count_if(counted).alias("n")))
    return settled, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on input of fewer partitions than cores; larger input is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
