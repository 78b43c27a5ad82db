import random

import pytest
from pyspark.sql import functions as F

from daqframe import streaming
from daqframe.operators import checks, layout, series, symbols
from daqframe.operators import time as times


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_as_of_by_stretches(spark, width):
    rng = random.Random(width)
    left = [(k, rng.randrange(-50, 100), i) for i, k in enumerate("abc" * 40)]
    right = [(k, rng.randrange(-30, 80), rng.randrange(5)) for k in "ab" * 15]
    got = times.as_of(spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, rt long, v long"), ["k"], "t", "rt", ["v"], width).collect()
    for r in got:
        before = [(t, v) for k, t, v in right if k == r.k and t <= r.t]
        assert (r.rt, r.v) == (max(before) if before else (None, None))
    assert len(got) == len(left)


def test_periodic_time_is_exact_and_guarded(spark):
    rows = [(0, 2**63 - 1, 1), (3, 2**62, 2**60), (2**32 - 1, 10**9 + 7, 3)]
    frame = spark.createDataFrame(rows, "n long, num long, den long")
    got = [r[0] for r in frame.select(times.periodic_time(F.lit(5).cast("long"), F.col("n"), F.col("num"), F.col("den"))).collect()]
    assert got == [5 + n * num // den for n, num, den in rows]
    with pytest.raises(Exception, match="(?i)overflow"):
        spark.createDataFrame([(4, 2**62, 1)], "n long, num long, den long").select(times.periodic_time(F.lit(5).cast("long"), F.col("n"), F.col("num"), F.col("den"))).collect()


@pytest.mark.parametrize("width", [None, 1, 4, 1000])
def test_correlation_ends(spark, width):
    samples = spark.createDataFrame([("c", t) for t in (0, 10, 15, 20, 30)], "k string, t long")
    points = spark.createDataFrame([("c", 10, 1000), ("c", 20, 1100)], "k string, s long, d long")
    got = {r.t: r.x for r in times.correlated(samples, points, ["k"], "t", "s", "d", "x", width).collect()}
    assert got == {0: 990, 10: 1000, 15: 1050, 20: 1100, 30: 1110}


@pytest.mark.parametrize("width", [None, 1, 1000])
def test_correlation_is_exact_in_integers(spark, width):
    base, far = 1_700_000_000_000_000_000, 2**60
    points = [("ns", base, base), ("ns", base + 4 * 10**9, base + 4 * 10**9 + 1), ("ns", base + 8 * 10**9, base - 7), ("big", 0, 0), ("big", 2 * far, 2 * (far + 1))]
    samples = [("ns", base + d) for d in (-5, 0, 1, 10**9, 4 * 10**9 - 1, 6 * 10**9 + 1, 9 * 10**9)] + [("big", far), ("big", 1)]
    got = times.correlated(spark.createDataFrame(samples, "k string, t long"), spark.createDataFrame(points, "k string, s long, d long"), ["k"], "t", "s", "d", "x", width).collect()
    for r in got:
        own = [(s, d) for k, s, d in points if k == r.k]
        low, high = max((p for p in own if p[0] <= r.t), default=None), min((p for p in own if p[0] > r.t), default=None)
        if low and high:
            assert r.x == low[1] + (r.t - low[0]) * (high[1] - low[1]) // (high[0] - low[0])
        else:
            assert r.x == (low[1] + r.t - low[0] if low else high[1] - (high[0] - r.t))
    assert len(got) == len(samples)


@pytest.mark.parametrize("rate", [1, 3, 1000, 44_100, 1_000_000, 1_000_000_000, 18_000_000_000])
def test_event_time_at_any_rate(spark, rate):
    ticks = [0, 1, rate - 1, 100 * rate, 1_700_000_000 * rate + 7, -1, -rate - 1]
    ticks = [t for t in ticks if abs(t) < 2**63]
    got = streaming.event_time(spark.createDataFrame([(t,) for t in ticks], "t long"), "t", rate).select("t", F.unix_micros("event_time")).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((t, t * 1_000_000 // rate) for t in ticks)


LANES = [(k, i * step + (step > 1 and i % 3 == 0), random.Random(i).randrange(-(2**63), 2**63)) for k, step, n in (("a", 1, 60), ("b", 17, 40), (None, 5, 20), ("c", 900, 8)) for i in range(n)]


def by_lane():
    out = {}
    for k, i, v in sorted(LANES, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(k, []).append((i, v))
    return out


def wrapped(x, bits):
    x %= 1 << bits
    return x - (1 << 64) if bits == 64 and x >= 1 << 63 else x


@pytest.fixture(scope="module")
def lanes(spark):
    """Lanes with columns whose names operators might use for themselves."""
    rows = random.Random(0).sample(LANES, len(LANES))
    extra = ("_stretch", "_carried", "_value", "_previous", "_break", "_low", "_into0", "missing")
    return spark.createDataFrame([(*r, *("kept",) * len(extra)) for r in rows], "k string, i long, v long, " + ", ".join(f"{c} string" for c in extra))


def result(frame, column):
    assert all(set(r.asDict().values()) >= {"kept"} and r["_stretch"] == r["_carried"] == r["_low"] == "kept" for r in frame.limit(3).collect())
    return {(r.k, r.i): r[column] for r in frame.collect()}


@pytest.mark.parametrize("width", [None, 1, 100])
def test_lanes_by_stretches(lanes, width):
    lane = (["k"], ["i"])
    for bits in (12, 63, 64):
        want = {(k, i): wrapped(v - p, bits) for k, rows in by_lane().items() for (i, v), p in zip(rows, [0] + [v for _, v in rows])}
        coded = series.delta_encode(lanes, "v", *lane, bits, "d", width)
        assert result(coded, "d") == want
        assert result(series.delta_decode(coded, "d", *lane, bits, "x", width), "x") == {(k, i): wrapped(v, bits) for k, i, v in LANES}
    coded = series.xor_encode(lanes, "v", *lane, "x", width)
    assert result(coded, "x") == {(k, i): v ^ p for k, rows in by_lane().items() for (i, v), p in zip(rows, [0] + [v for _, v in rows])}
    assert result(series.xor_decode(coded, "x", *lane, "y", width), "y") == {(k, i): v for k, i, v in LANES}
    small = lanes.withColumn("v", F.pmod("v", F.lit(1000)))
    falls, offsets, sizes = {}, {}, {}
    for k, rows in by_lane().items():
        n, at, last = 0, 64, None
        for i, v in rows:
            v %= 1000
            n += last is not None and v < last
            falls[k, i], offsets[k, i], sizes[k, i] = v + 1024 * n, at, v
            at, last = at + v, v
    assert result(series.unwrap(small, "v", *lane, 10, "u", width), "u") == falls
    assert result(series.record_offsets(small, "v", *lane, width=width), "record_offset") == offsets
    order = {(k, b): sizes[k, a] for k, rows in by_lane().items() for (a, _), (b, _) in zip(rows, rows[1:]) if sizes[k, b] <= sizes[k, a]}
    assert result(series.not_increasing(small, "v", *lane, width=width), "previous") == order
    gaps = {(k, b): b - a - 1 for k, rows in by_lane().items() for (a, _), (b, _) in zip(rows, rows[1:]) if b - a != 1}
    assert result(series.sequence_gaps(lanes, "i", ["k"], width), "missing") == gaps
    session = {}
    for k, rows in by_lane().items():
        n = 0
        for j, (i, _) in enumerate(rows):
            n += j > 0 and i - rows[j - 1][0] > 5
            session[k, i] = n
    assert result(times.sessions(lanes, ["k"], "i", 5, width), "session") == session


def test_sessions_with_equal_ticks(spark):
    frame = spark.createDataFrame([("a", t, n) for n, t in enumerate([0, 0, 5, 20, 20, 20, 21, 50])], "k string, t long, n long")
    for width in (None, 1, 10):
        assert {r.n: r.session for r in times.sessions(frame, ["k"], "t", 10, width).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2}


def test_delta_decode_of_long_lanes(spark):
    frame = spark.range(3000).select(F.lit("l").alias("k"), "id", F.lit((1 << 62) - 3).cast("long").alias("d"))
    for width in (None, 100):
        got = series.delta_decode(frame, "d", ["k"], ["id"], 62, "x", width).orderBy("id").collect()
        assert [r.x for r in got] == [(i + 1) * ((1 << 62) - 3) % (1 << 62) for i in range(3000)]


def test_zigzag_of_64_bits(spark):
    values = [0, -1, 1, 2**63 - 1, -(2**63), 12345678901234567]
    frame = spark.createDataFrame([(v,) for v in values], "v long").select("v", series.zigzag(F.col("v"), 64).alias("z")).select("*", series.unzigzag(F.col("z"), 64).alias("back"))
    assert {(r.v, r.z % 2**64, r.back) for r in frame.collect()} == {(v, 2 * v if v >= 0 else -2 * v - 1, v) for v in values}


def test_value_maps_and_members(spark):
    frame = spark.createDataFrame([(0x31,), (0,)], "raw long")
    members = [{"name": "sensor_failure", "lsb": 0, "width": 1}, {"name": "gnss_fix", "lsb": 4, "width": 3, "map_id": 1}, {"name": "reserved", "lsb": 7, "width": 9, "reserved": True}]
    got = sorted((r.raw, r.member, r.rendering) for r in symbols.bitfield_values(frame, "raw", members, {1: {0: "no_fix", 3: "sbas"}}).collect())
    assert got == [(0, "gnss_fix", "no_fix"), (0, "sensor_failure", "false"), (49, "gnss_fix", "sbas"), (49, "sensor_failure", "true")]


def test_references_of_several_columns(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, None)], "a long, b long")
    targets = spark.createDataFrame([(1, 1)], "x long, y long")
    assert sorted(map(str, checks.dangling(rows, targets, [("a", "x"), ("b", "y")]).collect())) == sorted(map(str, [r for r in rows.collect() if (r.a, r.b) in ((1, 2), (None, 1))]))
    assert [tuple(r) for r in checks.known(rows, targets, [("a", "x"), ("b", "y")]).collect()] == [(1, 1)]


def test_layout_positions_are_a_permutation(spark):
    frame = spark.range(600).crossJoin(spark.range(3).withColumnRenamed("id", "byte"))
    got = sorted(r[0] for r in frame.select(layout.shuffle_position(F.col("id"), F.col("byte"), F.lit(600), 3)).collect())
    assert got == list(range(1800))
