import zstandard
from pyspark.sql import functions as F

from daqframe import functions
from tests.engine import files


def test_sql_functions(spark):
    functions.register(spark)
    frame = zstandard.ZstdCompressor().compress(b"abc" * 50)
    spark.createDataFrame([(b"123456789", files.minimal(False), frame), (None, b"x", None)], "a binary, f binary, z binary").createOrReplaceTempView("bytes_in")
    got = spark.sql("SELECT crc32c(a) AS c, is_log(f) AS l, zstd_exact(z, 150L) AS z FROM bytes_in ORDER BY c NULLS LAST").collect()
    assert [(r.c, r.l, r.z) for r in got] == [(0xE3069283, True, b"abc" * 50), (None, False, None)]
    rows = spark.sql("SELECT s.raw FROM (SELECT f FROM bytes_in WHERE a IS NOT NULL) AS t, LATERAL daq_decode(t.f) AS s").collect()
    assert sorted(int(r.raw) for r in rows) == sorted([0, 4095, 291, 1110, 2748, 1929])


def test_signals_fit_their_width(spark):
    made = functions.signals(spark, 2000, 12, 4.0)
    for name in ("dc", "smooth", "stepped", "noise"):
        low, high = made.agg(F.min(name), F.max(name)).collect()[0]
        assert -2048 <= low <= high <= 2047
    assert made.select("dc").distinct().count() == 1
