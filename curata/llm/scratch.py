"""Small helpers that several operators use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.kernels import Bloom, mix
from curata.plans.scratch import Scratch

__all__ = ["Scratch", "bloom", "free_name", "held_out", "small_batches", "sorted_joins"]

#: Bytes of a batch of rows for Python, and Spark's setting for it. A batch of texts is in memory several times: in the JVM, whose
#: vectors grow by doubling, in the worker, and as what the worker keeps of it; each task at work has its own.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Spark's settings for the size up to which a side of a join is broadcast, in plans and in adaptive execution.
JOIN_SETTINGS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about BATCH_BYTES, unless the setting has been made already.

    Results never depend on batches. The setting stays, as what an operator returns is computed later.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def sorted_joins(spark: SparkSession) -> None:
    """From now on the session broadcasts a side of a join where a hint says so, and none for being small.

    A broadcast side is gathered and built in the driver, by a thread of its own, however small it is.
    Results never depend on it. The setting stays, as what an operator returns is computed later.
    """
    for name in JOIN_SETTINGS:
        spark.conf.set(name, -1)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like the given one that df, compared without case, doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column | str) -> Column:
    """The fixed fold: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bloom(values: DataFrame, col: str, rows: int) -> Bloom:
    """A Bloom filter of a bigint column, of 16 bits a value but at most 4 MB: a bound on what is collected and broadcast.

    Over the bound it only passes more values; it never loses one.
    """
    bits = 1 << min(25, max(12, int(max(1, rows) * 16 - 1).bit_length()))
    n = bits // 64
    hashed = []
    for seed in (0x51, 0x52):
        seeded = F.col(col).bitwiseXOR(F.lit(int(np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1).astype(np.int64))))
        hashed.append(seeded)
    @F.pandas_udf(T.LongType())
    def place(x):
        import pandas as pd

        return pd.Series((mix(x.to_numpy().astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).view(np.int64))

    bit = values.select(F.explode(F.array(*[place(h) for h in hashed])).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63L as int))")).alias("v"))
    out = np.zeros(n, np.uint64)
    got = words.toPandas()
    out[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.int64).view(np.uint64)
    return Bloom(out)
