"""Reading of tables, and intermediate tables that are removed once nothing needs them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import prepare, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that separate words, as a string and inside a regular expression.
BLANKS = "\t\n\x0b\x0c\r "


def ready(spark: SparkSession) -> SparkSession:
    """The library's settings, and batches for Python tasks that stay small however long the texts are.

    Python tasks look for this package where the driver found it, besides their own path.
    """
    prepare(spark)
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


class Scratch:
    """Tables written to the shared folder for the course of one operator.

    ``keep`` cuts the lineage: later steps read files, so a lost executor costs a re-read. ``drop``
    removes tables that a later kept table has made superfluous; call it only then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spanloom/{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._frames: list[DataFrame] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{len(self._frames)}"

    def keep(self, df: DataFrame, name: str = "step") -> DataFrame:
        path = self.path(name)
        df.write.mode("error").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = path
        self._frames.append(kept)  # ids stay unique while the frames live
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self.remove(self._paths.pop(id(frame)))

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key in turn, from batches sorted by ``keys``; a group may span batches."""
    held: list[pd.DataFrame] = []

    def flush() -> pd.DataFrame:
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        held.clear()
        return whole

    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values, strict=True)):
            yield flush()
        at = 0
        for cut in np.flatnonzero(change):
            held.append(batch.iloc[at:cut])
            yield flush()
            at = cut
        held.append(batch.iloc[at:])
    if held:
        yield flush()


def block_pairs(rows: DataFrame, size: Column, item: Column, block_rows: int) -> DataFrame:
    """Deals the rows of each group to pairs of blocks ``bi <= bj`` of about ``block_rows`` rows.

    ``size`` is the group's number of rows. A row of block b gets one copy for each pair b is in;
    ``side`` tells whether it is there as bi (0) or as bj (1). A group of one block has the pair 0, 0.
    """
    blocks = F.ceil(size / F.lit(block_rows)).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_b", F.pmod(F.xxhash64(item, F.lit(7)), F.col("_blocks")).cast("int"))
    spread = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread.withColumns({
        "bi": F.least("_b", "_other"), "bj": F.greatest("_b", "_other"),
        "side": (F.col("_b") > F.col("_other")).cast("int"),
    }).drop("_blocks", "_b", "_other")


#: Bits of a membership filter; its size does not depend on the data.
FILTER_BITS = 1 << 23


def maybe_member(members: DataFrame, key: str) -> Column:
    """Whether a row's ``key`` is perhaps among ``members``; false only where it is not.

    One bit per hash of a member, in a bit set of fixed size, so that rows of other keys need no
    shuffle. With too many members it is true everywhere; an exact join has to follow in any case.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(FILTER_BITS))
    words = members.select(place.alias("at")).groupBy(F.expr("at div 32").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for word, value in words.collect():  # at most FILTER_BITS / 32 rows
        bits[word] = value
    shared = members.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def among(at: pd.Series) -> pd.Series:
        found = at.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[found >> 5] >> (found & 31).astype(np.uint32)) & 1 == 1)

    return among(place)


def likely_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``members``, and few others, found without a shuffle of ``rows``."""
    return rows.filter(F.col(key).isNotNull()).filter(maybe_member(members, key))
