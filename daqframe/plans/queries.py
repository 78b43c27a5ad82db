"""Each operator as a query on the driver's tables, next to the SQL that gives the same rows.

Mapping: events are samples (event_type is the lane, event_id the order, ticks the microseconds of ts, raw the value in hundredths), lineitem is a table of four channels,
conversations are texts, pages and documents are binary items, embeddings are array channels, labels hold a bitfield, nations and regions are value maps.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daqframe import streaming
from daqframe.operators import checks, layout, series, symbols
from daqframe.operators import time as times
from daqframe.operators.lanes import with_folds
from daqframe.session import checkpointed, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RAW_SQL = "CAST(round(value * 100) AS BIGINT)"
# delta of raw within its lane, over 24 bits
LANE_SQL = f"SELECT event_id, event_type, {RAW_SQL} AS raw, coalesce(lag({RAW_SQL}) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS prev FROM events"
M24, H24 = (1 << 24) - 1, 1 << 23
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session's time zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return day * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + second


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("raw"), micros(F.col("ts")).alias("ticks"))


LANE = (["event_type"], ["event_id"])
# event ids to a stretch of a lane, and ticks to one of a key
STRETCH, DAY = 4096, 86_400_000_000


# --- values ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, {RAW_SQL} AS raw, CAST({RAW_SQL} AS DOUBLE) * CAST(0.01 AS DOUBLE) + CAST(1.5 AS DOUBLE) AS physical FROM events")
def q_physical(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "raw", symbols.physical(F.col("raw"), F.lit(0.01), F.lit(1.5)).alias("physical"))


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS DOUBLE) / CAST(100 AS DOUBLE) WHEN n_nationkey % 3 = 1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS scale, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'channel_' || n_nationkey END AS name FROM nation")
def q_scale_and_name(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    exact = F.when(key % 3 == 0, key)
    return n.select(
        "n_nationkey",
        symbols.resolved_scale(exact, F.lit(100), F.when(key % 3 == 1, 0.5)).alias("scale"),
        symbols.channel_name(F.when(key % 2 == 0, F.col("n_name")), key).alias("name"),
    )


@query("SELECT event_id, CASE WHEN (user_id * 37) % 4096 >= 2048 THEN (user_id * 37) % 4096 - 4096 ELSE (user_id * 37) % 4096 END AS signed FROM events")
def q_sign_extend(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", series.sign_extend(F.col("user_id") * 37, 12).alias("signed"))


@query(f"SELECT event_id, CAST({RAW_SQL} & 255 AS BIGINT) AS byte0, CAST(({RAW_SQL} >> 8) & 255 AS BIGINT) AS byte1, CAST(({RAW_SQL} >> 16) & 255 AS BIGINT) AS byte2 FROM events")
def q_byte_lanes(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", *(layout.byte_lane(F.col("raw"), k).alias(f"byte{k}") for k in range(3)))


# --- windows --------------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, event_type, CAST((raw - prev) & {M24} AS BIGINT) AS delta FROM ({LANE_SQL})")
def q_delta_encode(spark, sf_dir):
    return series.delta_encode(events(spark, sf_dir), "raw", *LANE, 24, "delta", STRETCH).select("event_id", "event_type", "delta")


@query(f"SELECT event_id, event_type, {RAW_SQL} AS raw FROM events")
def q_delta_decode(spark, sf_dir):
    return series.delta_decode(q_delta_encode(spark, sf_dir), "delta", *LANE, 24, "raw", STRETCH).select("event_id", "event_type", "raw")


# values near both ends of 64 bits, so that differences wrap
WIDE_SQL = f"CASE WHEN event_id & 1 = 1 THEN 9223372036854775807 - {RAW_SQL} ELSE {RAW_SQL} - 9223372036854775807 END"


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.lit(9223372036854775807).cast("long")
    return events(spark, sf_dir).withColumn("word", F.when(F.col("event_id").bitwiseAND(1) == 1, most - F.col("raw")).otherwise(F.col("raw") - most))


@query(f"""SELECT event_id, event_type, CAST(CASE WHEN d >= 9223372036854775808 THEN d - 18446744073709551616 ELSE d END AS BIGINT) AS delta FROM (
  SELECT event_id, event_type, ((CAST(word AS HUGEINT) - coalesce(lag(word) OVER (PARTITION BY event_type ORDER BY event_id), 0)) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 AS d
  FROM (SELECT event_id, event_type, {WIDE_SQL} AS word FROM events))""")
def q_delta_encode_64(spark, sf_dir):
    return series.delta_encode(wide_events(spark, sf_dir), "word", *LANE, 64, "delta", STRETCH).select("event_id", "event_type", "delta")


@query(f"SELECT event_id, event_type, {WIDE_SQL} AS word FROM events")
def q_delta_decode_64(spark, sf_dir):
    coded = q_delta_encode_64(spark, sf_dir).select("event_id", "event_type", series.unzigzag(series.zigzag(F.col("delta"), 64), 64).alias("delta"))
    return series.delta_decode(coded, "delta", *LANE, 64, "word", STRETCH).select("event_id", "event_type", "word")


@query(f"""SELECT event_id, event_type, CAST(CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END AS BIGINT) AS zigzag FROM (
  SELECT event_id, event_type, CASE WHEN word >= 0 THEN 2 * CAST(word AS HUGEINT) ELSE -2 * CAST(word AS HUGEINT) - 1 END AS z FROM (SELECT event_id, event_type, {WIDE_SQL} AS word FROM events))""")
def q_zigzag_64(spark, sf_dir):
    return wide_events(spark, sf_dir).select("event_id", "event_type", series.zigzag(F.col("word"), 64).alias("zigzag"))


SIGNED_SQL = f"(CASE WHEN ((raw - prev) & {M24}) >= {H24} THEN ((raw - prev) & {M24}) - {M24 + 1} ELSE ((raw - prev) & {M24}) END)"


@query(f"SELECT event_id, event_type, CAST(CASE WHEN {SIGNED_SQL} >= 0 THEN 2 * {SIGNED_SQL} ELSE -2 * {SIGNED_SQL} - 1 END AS BIGINT) AS zigzag FROM ({LANE_SQL})")
def q_zigzag(spark, sf_dir):
    return q_delta_encode(spark, sf_dir).select("event_id", "event_type", series.zigzag(F.col("delta"), 24).alias("zigzag"))


@query(f"SELECT event_id, event_type, CAST((raw - prev) & {M24} AS BIGINT) AS delta FROM ({LANE_SQL})")
def q_unzigzag(spark, sf_dir):
    return q_zigzag(spark, sf_dir).select("event_id", "event_type", series.unzigzag(F.col("zigzag"), 24).alias("delta"))


@query(f"SELECT event_id, event_type, xor(raw, prev) AS word FROM ({LANE_SQL})")
def q_xor_encode(spark, sf_dir):
    return series.xor_encode(events(spark, sf_dir), "raw", *LANE, "word", STRETCH).select("event_id", "event_type", "word")


@query(f"SELECT event_id, event_type, {RAW_SQL} AS raw FROM events")
def q_xor_decode(spark, sf_dir):
    return series.xor_decode(q_xor_encode(spark, sf_dir), "word", *LANE, "raw", STRETCH).select("event_id", "event_type", "raw")


@query("""
SELECT event_id, event_type, counter + CAST(sum(fell) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) * 4294967296 AS unwrapped FROM (
  SELECT event_id, event_type, counter, CASE WHEN counter < lag(counter) OVER (PARTITION BY event_type ORDER BY event_id) THEN 1 ELSE 0 END AS fell
  FROM (SELECT event_id, event_type, epoch_us(ts) % 4294967296 AS counter FROM events))""")
def q_counter_unwrap(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "event_type", F.pmod("ticks", F.lit(1 << 32)).alias("counter"))
    return series.unwrap(e, "counter", *LANE, 32, "unwrapped", STRETCH).select("event_id", "event_type", "unwrapped")


@query("SELECT doc_id, quality, previous, doc_id - previous - 1 AS missing FROM (SELECT doc_id, quality, lag(doc_id) OVER (PARTITION BY quality ORDER BY doc_id) AS previous FROM labels) WHERE doc_id - previous <> 1")
def q_sequence_gaps(spark, sf_dir):
    return series.sequence_gaps(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", ["quality"], STRETCH)


@query("SELECT conv_id, turn, size, previous FROM (SELECT conv_id, turn, length(text) AS size, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) WHERE size <= previous")
def q_index_monotonic(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("size"))
    return series.not_increasing(c, "size", ["conv_id"], ["turn"])


@query("SELECT source, doc_id, CAST(64 + coalesce(sum(96 + strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM documents")
def q_record_offsets(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("source", "doc_id", (F.octet_length("text") + 96).cast("long").alias("size"))
    return series.record_offsets(d, "size", ["source"], ["doc_id"], width=STRETCH).select("source", "doc_id", "record_offset")


# --- layout ---------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, channel_id, channel_name, value FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(1 AS BIGINT) AS channel_id, 'l_quantity' AS channel_name, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 2, 'l_extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 3, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 4, 'l_tax', l_tax FROM lineitem)""")
def q_long_form(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return layout.long_form(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {n: i + 1 for i, n in enumerate(names)})


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN {RAW_SQL} END) AS \"{t}\"" for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def q_wide_pivot(spark, sf_dir):
    return layout.wide_form(events(spark, sf_dir), ["user_id"], "event_type", "raw", EVENT_TYPES)


@query("SELECT event_id, event_id * 5 + user_id % 5 AS interleaved, (user_id % 5) * 1000000 + event_id AS planar, event_id AS sample, user_id % 5 AS lane FROM events")
def q_layout_positions(spark, sf_dir):
    sample, lane = F.col("event_id"), F.col("user_id") % 5
    position = layout.interleaved_position(sample, lane, F.lit(5))
    back = layout.from_interleaved(position, F.lit(5))
    planar = layout.planar_position(sample, lane, F.lit(0), F.lit(1), F.lit(1_000_000))
    return events(spark, sf_dir).select("event_id", position.alias("interleaved"), planar.alias("planar"), back[0].alias("sample"), back[1].alias("lane"))


@query("""SELECT n_regionkey, n_nationkey, CAST(coalesce(sum(length(n_name)) OVER w, 0) AS BIGINT) AS start_lane FROM nation
  WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_start_lanes(spark, sf_dir):
    n = load(spark, sf_dir, "nation").withColumn("elements", F.char_length("n_name"))
    return layout.start_lanes(n, ["n_regionkey"], "n_nationkey", "elements").select("n_regionkey", "n_nationkey", "start_lane")


@query("""SELECT event_id, event_type, CAST(i - i % 256 AS BIGINT) * 3 + 1 * least(256, n - (i - i % 256)) + i % 256 AS middle_byte FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def q_shuffle_position(spark, sf_dir):
    e = with_folds(events(spark, sf_dir), {"i": (F.lit(1).cast("long"), F.sum)}, *LANE, STRETCH).withColumn("i", F.col("i") - 1)
    e = e.join(F.broadcast(e.groupBy("event_type").agg(F.count("*").alias("n"))), "event_type")  # a row for each of the types
    return e.select("event_id", "event_type", layout.shuffle_position(F.col("i"), F.lit(1), F.col("n"), 3).cast("long").alias("middle_byte"))


@query("SELECT p_partkey, p_partkey * 40 + p_size AS first_bit, (p_partkey * (p_size + 11) + 7) // 8 AS dense, CAST((p_size + 7) // 8 AS BIGINT) AS aligned, ((p_partkey + 7) // 8) * 12 AS planes FROM part")
def q_payload_sizes(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return load(spark, sf_dir, "part").select(
        "p_partkey", layout.dense_bit(key, size, F.lit(40)).alias("first_bit"), layout.payload_bytes(key, size + 11).alias("dense"),
        layout.aligned_bytes(size).alias("aligned"), layout.bit_plane_bytes(key, F.lit(12)).alias("planes"),
    )


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS element, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def q_array_lanes(spark, sf_dir):
    return layout.array_lanes(load(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").withColumn("value", F.col("value").cast("double"))


# --- time -----------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(1000000 + (CAST(event_id AS HUGEINT) * CAST((1 + user_id % 7) * 1000000007 AS HUGEINT)) // CAST(3 + user_id % 5 AS HUGEINT) AS BIGINT) AS ticks FROM events")
def q_periodic_time(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", times.periodic_time(F.lit(1_000_000).cast("long"), F.col("event_id"), (1 + F.col("user_id") % 7) * 1_000_000_007, 3 + F.col("user_id") % 5).alias("ticks"))


@query("SELECT event_id, epoch_us(ts) AS ticks, epoch_us(ts) - 1700000000000000 AS delta FROM events")
def q_delta_time(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("delta", F.col("ticks") - 1_700_000_000_000_000)
    return e.select("event_id", times.delta_time(F.lit(1_700_000_000_000_000).cast("long"), F.col("delta")).alias("ticks"), "delta")


@query("SELECT event_type, CAST(event_id // 1024 AS BIGINT) AS chunk, min(event_id) AS first_index, count(*) AS count, min(epoch_us(ts)) AS first_ticks, max(epoch_us(ts)) AS last_ticks FROM events GROUP BY ALL")
def q_chunk_index(spark, sf_dir):
    return checks.chunk_index(events(spark, sf_dir), ["event_type"], "event_id", "ticks", 1024)


@query("""SELECT p.event_id, p.user_id, c.ticks AS click_ticks, c.raw AS click_raw
  FROM (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) AS ticks, CAST(round(value * 100) AS BIGINT) AS raw FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.t >= c.ticks""")
def q_clock_asof(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ticks")
    right = e.where("event_type = 'click'").select("user_id", F.col("ticks").alias("click_ticks"), F.col("raw").alias("click_raw"))
    return times.as_of(left, right, ["user_id"], "ticks", "click_ticks", ["click_raw"], width=DAY).select("event_id", "user_id", "click_ticks", "click_raw")


@query(f"""WITH points AS (SELECT user_id, epoch_us(ts) * 1000 AS s, max(epoch_us(ts) * 1000 + {RAW_SQL} * 1000003) AS d FROM events WHERE event_type = 'click' GROUP BY ALL),
  low AS (SELECT e.event_id, e.user_id, epoch_us(e.ts) * 1000 AS t, p.s AS ls, p.d AS ld FROM events e ASOF LEFT JOIN points p ON e.user_id = p.user_id AND epoch_us(e.ts) * 1000 >= p.s),
  both_ends AS (SELECT low.*, p.s AS hs, p.d AS hd, CAST(t - ls AS HUGEINT) * CAST(p.d - ld AS HUGEINT) AS x, CAST(p.s - ls AS HUGEINT) AS q FROM low ASOF LEFT JOIN points p ON low.user_id = p.user_id AND low.t < p.s)
  SELECT event_id, user_id, CASE WHEN ls IS NOT NULL AND hs IS NOT NULL THEN CAST(ld + (x - (x % q + q) % q) // q AS BIGINT) WHEN ls IS NOT NULL THEN ld + (t - ls) WHEN hs IS NOT NULL THEN hd - (hs - t) END AS target_ticks FROM both_ends""")
def q_clock_interpolation(spark, sf_dir):
    """Nanosecond ticks of all events on a clock whose correlation points are the clicks."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", (F.col("ticks") * 1000).alias("ticks"), "raw")
    points = e.where("event_type = 'click'").select("user_id", F.col("ticks").alias("source"), (F.col("ticks") + F.col("raw") * 1_000_003).alias("target"))
    return times.correlated(e.select("event_id", "user_id", "ticks"), points, ["user_id"], "ticks", "source", "target", "target_ticks", width=1000 * DAY).select("event_id", "user_id", "target_ticks")


@query("SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts) AS nanos, "
       "CAST(CAST(epoch_us(ts) AS HUGEINT) * 1000000 // 44100 AS BIGINT) AS audio, epoch_us(ts) // 1000000 * 1000000 AS seconds FROM events")  # fmt: skip
def q_event_time(spark, sf_dir):
    """Microseconds of timestamps made of ticks of a microsecond, a nanosecond, a 44,100th of a second and a second."""
    e = events(spark, sf_dir).select("event_id", "ticks", (F.col("ticks") * 1000 + 999).alias("nano"), F.floor(F.col("ticks") / 1_000_000).alias("second"))
    for name, ticks, rate in (("micros", "ticks", 1_000_000), ("nanos", "nano", 1_000_000_000), ("audio", "ticks", 44_100), ("seconds", "second", 1)):
        e = streaming.event_time(e, ticks, rate, "_time").withColumn(name, F.unix_micros("_time")).drop("_time")
    return e.select("event_id", "micros", "nanos", "audio", "seconds")


@query("SELECT event_type, epoch_us(ts) - epoch_us(ts) % 3600000000 AS bucket, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def q_time_bucket(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("bucket", times.bucket(F.col("ticks"), 3_600_000_000))
    return e.groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.sum("raw").alias("total"))


@query("""SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS session FROM (
  SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600000000 THEN 1 ELSE 0 END AS new FROM events)""")
def q_sessions(spark, sf_dir):
    return times.sessions(events(spark, sf_dir), ["user_id"], "ticks", 21_600_000_000, DAY).select("event_id", "user_id", "session")


# --- symbols --------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, m.member AS member, m.value AS value, m.rendering AS rendering FROM (SELECT doc_id, unnest([
    {'member': 'quality', 'value': CAST(quality AS BIGINT), 'rendering': CASE WHEN quality = 1 THEN 'true' ELSE 'false' END},
    {'member': 'toxic', 'value': CAST(toxic AS BIGINT), 'rendering': CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END},
    {'member': 'both', 'value': CAST(quality + 2 * toxic AS BIGINT), 'rendering': CASE quality + 2 * toxic WHEN 0 THEN 'bad' WHEN 1 THEN 'good' WHEN 2 THEN 'bad, toxic' ELSE '3' END}]) AS m FROM labels)""")
def q_bitfield_members(spark, sf_dir):
    bits = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.shiftleft("toxic", 1)).cast("long").alias("raw"))
    members = [{"name": "quality", "lsb": 0, "width": 1}, {"name": "toxic", "lsb": 1, "width": 1}, {"name": "both", "lsb": 0, "width": 2, "map_id": 1}, {"name": "spare", "lsb": 2, "width": 6, "reserved": True}]
    return symbols.bitfield_values(bits, "raw", members, {1: {0: "bad", 1: "good", 2: "bad, toxic"}}).drop("raw")


@query("SELECT n_nationkey, CAST(n_nationkey % 7 AS BIGINT) AS raw, r_name AS value_name FROM nation LEFT JOIN region ON n_nationkey % 7 = r_regionkey")
def q_value_map(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 7).cast("long").alias("raw"))
    entries = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("raw"), F.col("r_name").alias("name"))
    return symbols.map_values(n, "raw", entries).select("n_nationkey", "raw", "value_name")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'info' WHEN 'assistant' THEN 'debug' ELSE 'warning' END AS severity, length(text) AS size FROM conversations")
def q_text_severity(spark, sf_dir):
    level = F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 2).otherwise(4)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", symbols.severity_name(level).alias("severity"), F.char_length("text").cast("long").alias("size"))


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 'SCMA' WHEN 2 THEN 'DATA' WHEN 3 THEN 'TEXT' WHEN 4 THEN 'INDX' WHEN 5 THEN 'END!' WHEN 6 THEN 'BLOB' ELSE '0x' || lpad(lower(hex(p_size)), 4, '0') END AS type FROM part")
def q_type_names(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", symbols.mnemonic(F.col("p_size")).alias("type"))


# --- checks ---------------------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS items, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS BIGINT) AS largest FROM documents GROUP BY source")
def q_blob_sizes(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("items"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


@query("SELECT conv_id, count(*) + 1 AS total_records, count(*) FILTER (role = 'user') AS data_records FROM conversations GROUP BY conv_id")
def q_end_totals(spark, sf_dir):
    return checks.end_totals(load(spark, sf_dir, "conversations"), ["conv_id"], F.col("role") == "user")


@query("SELECT doc_id, lang FROM documents d WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_dangling_refs(spark, sf_dir):
    return checks.dangling(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "marked"), [("doc_id", "marked")])


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_known_refs(spark, sf_dir):
    return checks.known(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "marked"), [("doc_id", "marked")])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def q_duplicate_ids(spark, sf_dir):
    return checks.duplicates(load(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT p_brand, count(*) AS entries, count(DISTINCT p_size) AS raws, count(DISTINCT p_type) AS names FROM part GROUP BY p_brand HAVING count(*) <> count(DISTINCT p_size) OR count(*) <> count(DISTINCT p_type)")
def q_map_unique(spark, sf_dir):
    return checks.not_one_to_one(load(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_type")


@query("""SELECT n_regionkey, n_nationkey, taken_to FROM (SELECT n_regionkey, n_nationkey, max(n_nationkey + length(n_name)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken_to FROM nation) WHERE n_nationkey < taken_to""")
def q_bitfield_overlap(spark, sf_dir):
    """Nations as members of a region's bitfield, as wide as their names are long."""
    m = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.char_length("n_name").cast("long").alias("width"))
    return checks.overlapping(m, ["n_regionkey"], "n_nationkey", "width").drop("width")


@query("SELECT r_regionkey, r_regionkey + 3 AS declared, count(n_nationkey) AS found FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey HAVING count(n_nationkey) <> r_regionkey + 3")
def q_channel_counts(spark, sf_dir):
    declared = load(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") + 3).alias("declared"))
    return checks.miscounted(declared, load(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey", "declared")


@query("SELECT l_orderkey, min(l_returnflag) = max(l_returnflag) AND min(l_linestatus) = max(l_linestatus) AS homogeneous FROM lineitem GROUP BY l_orderkey")
def q_homogeneous(spark, sf_dir):
    return checks.homogeneous(load(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("SELECT lang, source, count(DISTINCT text) AS definitions FROM documents GROUP BY lang, source HAVING count(DISTINCT text) > 1")
def q_schema_redefined(spark, sf_dir):
    return checks.redefined(load(spark, sf_dir, "documents"), ["lang", "source"], "text")


# --- through files --------------------------------------------------------------------------------------------------------


def through_files(rows: DataFrame, read: str = "samples", columns: str = "", **options) -> DataFrame:
    """rows written as log files, and a table of these."""
    from daqframe import sources

    spark = rows.sparkSession
    sources.register(spark)
    path = shared_path(spark, "logs")
    rows.write.format("daq").options(path=path, **options).mode("append").save()
    return sources.read(spark, path, read, **({"columns": columns} if columns else {}))


@query(f"SELECT event_id, user_id, {RAW_SQL} AS raw, epoch_us(ts) AS time_ticks FROM events")
def q_roundtrip_rows(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "raw", F.col("ticks").alias("time_ticks"))
    back = through_files(e, "wide", "event_id long, user_id long, raw long", compression="integer", layout="planar")
    return back.select("event_id", "user_id", "raw", "time_ticks")


@query("SELECT value, value / 3.0 AS third FROM events")
def q_roundtrip_bitwise(spark, sf_dir):
    e = events(spark, sf_dir).select("value", (F.col("value") / 3.0).alias("third"))
    return through_files(e, "wide", "value double, third double", compression="bitwise").select("value", "third")


ADC_SQL = f"(({RAW_SQL} % 4096 + 4096) % 4096)"


@query(f"""SELECT event_id, 'adc' AS channel_name, 1 AS logical_type, CAST({ADC_SQL} AS VARCHAR) AS raw, CAST({ADC_SQL} AS DOUBLE) * CAST(0.25 AS DOUBLE) + CAST(-3 AS DOUBLE) AS physical, 'V' AS unit FROM events
  UNION ALL SELECT event_id, 'level', 2, CAST({ADC_SQL} - 2048 AS VARCHAR), CAST({ADC_SQL} - 2048 AS DOUBLE) / CAST(128 AS DOUBLE), 'dB' FROM events
  UNION ALL SELECT event_id, 'high', 4, CASE WHEN {ADC_SQL} >= 2048 THEN '1' ELSE '0' END, CASE WHEN {ADC_SQL} >= 2048 THEN 1.0 ELSE 0.0 END, NULL FROM events
  UNION ALL SELECT event_id, 'wide', 1, CAST(CAST(18446744073709551615 AS HUGEINT) - {ADC_SQL} AS VARCHAR), CAST(CAST(18446744073709551615 AS HUGEINT) - {ADC_SQL} AS DOUBLE), NULL FROM events""")
def q_roundtrip_channels(spark, sf_dir):
    """Channels of 12 unsigned, 12 signed, 1 and 64 unsigned bits, scaled and densely packed; the event rides in the times."""
    adc = F.pmod("raw", F.lit(4096).cast("long"))
    most = F.lit("18446744073709551615").cast("decimal(20,0)")
    e = events(spark, sf_dir).select(F.col("event_id").alias("time_ticks"), adc.alias("adc"), (adc - 2048).cast("int").alias("level"), (adc >= 2048).alias("high"), (most - adc.cast("decimal(4,0)")).cast("decimal(20,0)").alias("wide"))
    channels = {"adc": {"type": "unsigned", "bits": 12, "unit": "V", "scale": 0.25, "offset": -3}, "level": {"bits": 12, "unit": "dB", "scale": [1, 128]}}
    back = through_files(e, channels=json.dumps(channels), layout="planar", time="delta", chunk="1000")
    return back.select(F.col("time_ticks").alias("event_id"), "channel_name", "logical_type", F.col("raw").cast("string").alias("raw"), "physical", "unit")


@query(f"SELECT event_id, {ADC_SQL} AS adc, CAST(5 AS BIGINT) AS start FROM events")
def q_roundtrip_periodic(spark, sf_dir):
    """Aligned packing, checksums in trailers, times by period; physical values stored as the nearest raw."""
    adc = F.pmod("raw", F.lit(4096).cast("long"))
    e = events(spark, sf_dir).select("event_id", (adc * 0.5).alias("adc"))
    back = through_files(e, "wide", "event_id long, adc long", channels='{"adc": {"type": "unsigned", "bits": 12, "storage": 20, "scale": [1, 2]}}', packing="aligned", trailer="true", period="40", start="5", chunk="512")
    return back.select("event_id", "adc", (F.col("time_ticks") - F.col("sample_index").cast("long") * 40).alias("start"))


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS element, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def q_roundtrip_arrays(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("time_ticks"), "embedding")
    (n,) = e.select(F.max(F.size("embedding"))).first()
    back = through_files(e, channels=json.dumps({"embedding": {"elements": n or 1}}), compression="bitwise", layout="interleaved")
    return back.select(F.col("time_ticks").alias("vec_id"), "element", F.col("numeric").alias("value"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def q_roundtrip_bytes(spark, sf_dir):
    """Channels of 32 fixed bytes."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("time_ticks"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    back = through_files(d, channels='{"digest": {"bits": 256}}')
    return back.select(F.col("time_ticks").alias("doc_id"), F.lower(F.hex("raw_bytes")).alias("digest"))


@query("SELECT text AS message FROM conversations")
def q_roundtrip_notes(spark, sf_dir):
    return through_files(load(spark, sf_dir, "conversations").select(F.col("text").alias("message")), "notes", table="notes").select("message")


@query("SELECT CAST(32768 + turn AS INTEGER) AS type_id, '0x' || lower(hex(32768 + turn)) AS type, sha256(text) AS digest, strlen(text) AS payload_size FROM conversations")
def q_roundtrip_private(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select((32768 + F.col("turn")).cast("int").alias("type_id"), F.col("text").cast("binary").alias("payload"))
    return through_files(c, "records", table="records").where("type_id >= 32768").select("type_id", "type", F.sha2("payload", 256).alias("digest"), "payload_size")


@query("SELECT event_type, adc, CASE adc % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'run' ELSE CAST(adc % 4 AS VARCHAR) END AS state, n FROM (SELECT event_type, CAST(" + ADC_SQL + " % 16 AS BIGINT) AS adc, count(*) AS n FROM events GROUP BY ALL)")
def q_roundtrip_symbols(spark, sf_dir):
    """Value maps and bitfields written with the rows and used from what is read back."""
    from daqframe import sources

    path = symbol_logs(spark, sf_dir)
    rows = sources.read(spark, path, "wide", columns="status long, kind long").select("kind", F.col("status").alias("adc"))
    entries = sources.read(spark, path, "value_map_entries").select("map_id", F.col("raw").cast("long").alias("raw"), "name").distinct()
    members = sources.read(spark, path, "bitfield_members").where("name = 'state'").select("lsb", F.col("map_id")).distinct()
    counted = rows.groupBy("kind", "adc").agg(F.count("*").alias("n"))
    # a row for each entry of the member's map
    states = F.broadcast(entries.join(F.broadcast(members), "map_id").select(F.col("raw").alias("key"), F.col("name").alias("state")))
    named = counted.withColumn("key", F.col("adc").bitwiseAND(3)).join(states, "key", "left")
    kinds = F.broadcast(entries.where("map_id = 2").select(F.col("raw").alias("kind"), F.col("name").alias("event_type")))
    return named.join(kinds, "kind").select("event_type", "adc", F.coalesce("state", F.col("key").cast("string")).alias("state"), "n")


def symbol_logs(spark: SparkSession, sf_dir: str) -> str:
    """The path of logs whose channels have a bitfield and a value map and whose stream has a clock."""
    from daqframe import sources

    sources.register(spark)
    path = shared_path(spark, "logs")
    e = events(spark, sf_dir).select(F.pmod("raw", F.lit(4096).cast("long")).bitwiseAND(15).cast("int").alias("status"), F.array_position(F.array(*(F.lit(t) for t in EVENT_TYPES)), F.col("event_type")).cast("int").alias("kind"), F.col("ticks").alias("time_ticks"))
    objects = {
        "clocks": {"1": {"name": "host", "domain": 1, "tick": [1, 1_000_000], "bits": 64}},
        "value_maps": {"1": {"name": "state", "entries": [[0, "idle"], [1, "run", "is running"]]}, "2": {"name": "kind", "entries": [[i + 1, t] for i, t in enumerate(EVENT_TYPES)]}},
        "bitfields": {"1": {"name": "status", "bits": 16, "members": [{"lsb": 0, "width": 2, "name": "state", "map": 1}, {"lsb": 2, "width": 2, "name": "spare", "reserved": True}]}},
    }
    channels = {"status": {"type": "unsigned", "bits": 16, "bitfield": 1}, "kind": {"type": "unsigned", "bits": 8, "storage": 8, "value_map": 2}}
    e.write.format("daq").options(path=path, objects=json.dumps(objects), channels=json.dumps(channels), clock="1", timeDomain="1", timeUnit="1/1000000").mode("append").save()
    return path


@query("""SELECT * FROM (VALUES ('clock of a stream', 1, 0), ('value map of a channel', 1, 0), ('bitfield of a channel', 1, 0), ('value map of a member', 1, 0), ('bits of a bitfield', 1, 0), ('unit of a stream', 1, 0),
  ('id of an object', 7, 0), ('raw value of a map', 7, 0), ('place of a member', 2, 0)) AS t(rule, kept, broken)""")
def q_object_rules(spark, sf_dir):
    """What schemas say of each other, by the checks over the tables that are read back: how often a file keeps each rule, and how often one is broken."""
    from daqframe import sources

    path = symbol_logs(spark, sf_dir)
    # small tables, each read from the files once
    read = {t: checkpointed(sources.read(spark, path, t)) for t in ("objects", "channels", "streams", "clocks", "value_map_entries", "bitfield_members")}
    maps = read["value_map_entries"].select(F.col("path").alias("at"), F.col("map_id").alias("target"))
    clocks = read["clocks"].select(F.col("path").alias("at"), F.col("clock_id").alias("target"))
    fields = read["bitfield_members"].select(F.col("path").alias("at"), F.col("bitfield_id").alias("target"))

    def reference(rule: str, rows: DataFrame, column: str, targets: DataFrame) -> DataFrame:
        keys = [("path", "at"), (column, "target")]
        whole = rows.where(F.col(column).isNotNull()).select("path", column)
        return checks.known(whole, targets, keys).select(F.lit(rule).alias("rule"), "path", F.lit(1).alias("kept")).unionByName(checks.dangling(whole, targets, keys).select(F.lit(rule).alias("rule"), "path", F.lit(0).alias("kept")))

    def held(rule: str, rows: DataFrame, test: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), "path", test.cast("int").alias("kept"))

    wide = read["channels"].join(read["bitfield_members"].select("path", "bitfield_id", F.col("storage_bits").alias("field_bits")).distinct(), ["path", "bitfield_id"])
    unit = read["streams"].join(read["clocks"], ["path", "clock_id"])
    same_unit = F.col("time_unit_num") * F.col("tick_den") == F.col("tick_num") * F.col("time_unit_den")
    ids = read["objects"].join(checks.duplicates(read["objects"], ["path", "kind", "object_id"]), ["path", "kind", "object_id"], "left")
    raws = read["value_map_entries"].join(checks.duplicates(read["value_map_entries"], ["path", "map_id", "raw"]), ["path", "map_id", "raw"], "left")
    places = read["bitfield_members"].select("path", "bitfield_id", "lsb", "width")
    overlaps = checks.overlapping(places, ["path", "bitfield_id"], "lsb", "width").select("path", "bitfield_id", "lsb", F.lit(1).alias("n"))
    found = [
        reference("clock of a stream", read["streams"], "clock_id", clocks),
        reference("value map of a channel", read["channels"], "value_map_id", maps),
        reference("bitfield of a channel", read["channels"], "bitfield_id", fields),
        reference("value map of a member", read["bitfield_members"], "map_id", maps),
        held("bits of a bitfield", wide, F.col("storage_bits") == F.col("field_bits")),
        held("unit of a stream", unit, same_unit),
        held("id of an object", ids, F.col("n").isNull()),
        held("raw value of a map", raws, F.col("n").isNull()),
        held("place of a member", places.join(overlaps, ["path", "bitfield_id", "lsb"], "left"), F.col("n").isNull()),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    per_file = every.groupBy("rule", "path").agg(F.sum("kept").alias("kept"), F.sum(1 - F.col("kept")).alias("broken"))
    return per_file.groupBy("rule").agg(F.max("kept").cast("int").alias("kept"), F.sum("broken").cast("int").alias("broken"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell, CAST(to_json(struct_pack(message := text)) AS VARCHAR) AS line FROM conversations""")
def q_text_cells(spark, sf_dir):
    """Texts as CSV cells and as JSON."""
    from daqframe.sources.export import quoted

    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", quoted(F.col("text")).alias("cell"), F.to_json(F.struct(F.col("text").alias("message")), {"ignoreNullFields": "false"}).alias("line"))


@query("SELECT count(*) AS samples, min(epoch_us(ts)) AS first_ticks, max(epoch_us(ts)) AS last_ticks, true AS totals_agree, true AS found FROM events")
def q_index_and_end(spark, sf_dir):
    """What indexes and end records say of the files that hold the events, against the records there are."""
    from daqframe import sources

    sources.register(spark)
    path = shared_path(spark, "logs")
    events(spark, sf_dir).select("event_id", F.col("ticks").alias("time_ticks")).write.format("daq").options(path=path, chunk="256").mode("append").save()
    index = sources.read(spark, path, "index_entries")
    records = sources.read(spark, path, "records")
    end = sources.read(spark, path, "end_records").select("path", "total_records", "data_records", "last_index_offset")
    counted = records.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "DATA").alias("d"), F.max(F.when(F.col("type") == "INDX", F.col("record_offset"))).alias("i"))
    agree = end.join(counted, "path", "full").agg(F.bool_and(F.coalesce((F.col("n") == F.col("total_records")) & (F.col("d") == F.col("data_records")) & (F.coalesce("i", F.lit(0)) == F.col("last_index_offset")), F.lit(False))).alias("totals_agree"))
    met = index.join(records.select("path", "record_offset", F.col("sequence").alias("target_sequence")), ["path", "record_offset", "target_sequence"], "left_semi").agg(F.count("*").alias("met"))
    sums = index.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("samples"), F.min("first_time_ticks").alias("first_ticks"), F.max("last_time_ticks").alias("last_ticks"), F.count("*").alias("entries"))
    every = sums.unionByName(agree, allowMissingColumns=True).unionByName(met, allowMissingColumns=True)  # three rows
    return every.agg(*(F.max(c).alias(c) for c in ("samples", "first_ticks", "last_ticks", "totals_agree")), (F.max("met") == F.max("entries")).alias("found"))


@query(f"SELECT event_id, {RAW_SQL} AS raw FROM events")
def q_truncated_tail(spark, sf_dir):
    """Files that end inside their last record lose that record alone."""
    from daqframe import sources
    from daqframe.sources.daq import decoded

    sources.register(spark)
    path = shared_path(spark, "logs")
    events(spark, sf_dir).select(F.col("event_id").alias("time_ticks"), "raw").write.format("daq").options(path=path, trailer="true").mode("append").save()
    cut = spark.read.format("binaryFile").load(path).select("path", F.expr("substring(content, 1, length(content) - 20)").alias("content"))
    return decoded(cut).select(F.col("time_ticks").alias("event_id"), F.col("raw").cast("long").alias("raw"))


@query("SELECT channel_name, count(*) AS n, CAST(sum(raw) AS BIGINT) AS total, min(time_ticks) AS first_ticks, max(time_ticks) AS last_ticks FROM ("
       f"SELECT 'raw' AS channel_name, {RAW_SQL} AS raw, epoch_us(ts) AS time_ticks FROM events UNION ALL SELECT 'user_id', user_id, epoch_us(ts) FROM events) GROUP BY channel_name")  # fmt: skip
def q_stream_statistics(spark, sf_dir):
    e = events(spark, sf_dir).select("raw", "user_id", F.col("ticks").alias("time_ticks"))
    return through_files(e, compression="zstd").groupBy("channel_name").agg(F.count("*").alias("n"), F.sum(F.col("raw").cast("long")).alias("total"), F.min("time_ticks").alias("first_ticks"), F.max("time_ticks").alias("last_ticks"))


@query("SELECT conv_id AS source_id, CAST(turn AS INTEGER) AS event_code, CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 4 END AS severity, text AS message FROM conversations")
def q_roundtrip_text(spark, sf_dir):
    level = F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 2).otherwise(4)
    c = load(spark, sf_dir, "conversations").select(F.col("turn").alias("time_ticks"), level.alias("severity"), F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("event_code"), F.col("text").alias("message"))
    return through_files(c, "text", table="text").select("source_id", "event_code", "severity", "message")


@query("SELECT page_id, strlen(html) AS size, sha256(html) AS digest FROM pages")
def q_roundtrip_items(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("item_index"), F.col("html").cast("binary").alias("data")).sortWithinPartitions("item_index")
    back = through_files(p, "blobs", table="blobs", contentType="text/html")
    return back.select(F.col("item_index").cast("long").alias("page_id"), F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("digest"))


@query(f"SELECT event_id || ',' || {RAW_SQL} AS line FROM events")
def q_csv_lines(spark, sf_dir):
    from daqframe.sources.export import csv_lines

    e = events(spark, sf_dir).select("event_id", "raw")
    lines = csv_lines(through_files(e, compression="integer")).select("path", "sample_index", "channel_id", F.element_at(F.split("line", ","), 8).alias("cell"))
    both = lines.groupBy("path", "sample_index").agg(F.max(F.when(F.col("channel_id") == 1, F.col("cell"))).alias("a"), F.max(F.when(F.col("channel_id") == 2, F.col("cell"))).alias("b"))
    return both.select(F.concat_ws(",", "a", "b").alias("line"))


@query("SELECT 'TEXT' AS type, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations UNION ALL SELECT unnest(['SCMA', 'END!']), 1, NULL")
def q_record_types(spark, sf_dir):
    """Records by type; of schemas and ends how many a file has."""
    texts = load(spark, sf_dir, "conversations").select(F.col("text").alias("message"))
    records = through_files(texts, "records", table="text")
    counted = records.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"), F.sum("payload_size").alias("bytes"))
    is_text = F.col("type") == "TEXT"
    return counted.select("type", F.when(is_text, F.col("n")).otherwise(F.expr("n div files")).alias("n"), F.when(is_text, F.col("bytes")).alias("bytes"))


# --- streaming ------------------------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    return stream.select("event_type", F.round(F.col("value") * 100).cast("long").alias("raw"), F.timestamp_micros(micros(F.col("ts"))).alias("event_time"))


@query("SELECT event_type, epoch_us(ts) // 21600000000 * 21600000000 AS window_us, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def q_stream_windows(spark, sf_dir):
    windows = streaming.tumbling(event_stream(spark, sf_dir), "event_time", ["event_type"], "raw", "6 hours")
    found = streaming.memory_table(windows, f"windows_{uuid.uuid4().hex}", "complete")
    return found.select("event_type", F.unix_micros("window_start").alias("window_us"), "n", "total")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: events through log files and back, statistics by channel."""
    return q_stream_statistics(spark, sf_dir)
