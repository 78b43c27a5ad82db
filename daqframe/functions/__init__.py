"""SQL functions over bytes, and synthetic signals.

``register(spark)`` adds ``crc32c(binary)``, ``zstd_exact(binary, long)``, ``is_log(binary)`` and the table function ``daq_decode(binary)``. All work on Arrow batches or whole
files; none runs row by row through Python pickling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.pandas.types import from_arrow_schema

from daqframe import wire as w
from daqframe.tables import arrow_schema

DECODED = T.StructType([f for f in from_arrow_schema(arrow_schema("samples")) if f.name != "path"])


@arrow_udf(T.LongType())
def crc32c(data: pa.Array) -> pa.Array:
    """CRC-32C of each value as an unsigned number; null for null."""
    from daqframe.crc import crc32c as crc

    return pa.array([None if x is None else crc(x) for x in data.to_pylist()], pa.int64())


@arrow_udf(T.BinaryType())
def zstd_exact(data: pa.Array, size: pa.Array) -> pa.Array:
    """What one Zstandard frame of exactly this size holds; null for null, an error for any other bytes."""
    from daqframe.codec import decompress

    return pa.array([None if x is None or n is None else decompress(x, n) for x, n in zip(data.to_pylist(), size.to_pylist())], pa.binary())


@arrow_udf(T.BooleanType())
def is_log(data: pa.Array) -> pa.Array:
    """Does it start with a sound file header?"""

    def sound(x: bytes | None) -> bool | None:
        if x is None:
            return None
        try:
            w.FileHeader.parse(x[: w.Limits().header])
        except w.FormatError:
            return False
        return True

    return pa.array([sound(x) for x in data.to_pylist()], pa.bool_())


@udtf(returnType=DECODED)
class DaqDecode:
    """The sample rows of a whole file's bytes."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        from daqframe.tables import decode_bytes

        if content is not None:
            for r in decode_bytes(bytes(content)).drop_columns(["path"]).to_pylist():
                yield tuple(r.values())


def register(spark: SparkSession) -> None:
    for name, f in (("crc32c", crc32c), ("zstd_exact", zstd_exact), ("is_log", is_log)):
        spark.udf.register(name, f)
    spark.udtf.register("daq_decode", DaqDecode)


# --- signals ------------------------------------------------------------------------------------------------------------


def clamped(value: Column, bits: int) -> Column:
    """A signed number of so many bits, cut at both ends."""
    return F.greatest(F.lit(-(1 << (bits - 1))), F.least(F.lit((1 << (bits - 1)) - 1), F.round(value).cast("long")))


def signals(spark: SparkSession, samples: int, bits: int, noise: float = 1.0, seed: int = 1) -> DataFrame:
    """sample, and a constant, a sine, a stepped and a noisy channel of so many bits, each with Gaussian noise of so many steps but the constant."""
    n, top = F.col("id"), 1 << (bits - 2)
    return spark.range(samples).select(
        n.alias("sample"),
        F.lit(top).cast("long").alias("dc"),
        clamped(top * F.sin(n / 50.0) + noise * F.randn(seed), bits).alias("smooth"),
        clamped((F.floor(n / 256) % 8 - 4) * (top / 4) + noise * F.randn(seed + 1), bits).alias("stepped"),
        clamped((F.rand(seed + 2) - 0.5) * 2 * top, bits).alias("noise"),
    )
