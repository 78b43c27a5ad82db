"""The plans that queries get: pruned scans, no nested loops, no row-by-row Python."""

import re

import pytest

from daqframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
FILES = [n for n in QUERIES if "roundtrip" in n or n in ("q_stream_statistics", "q_csv_lines", "q_record_types", "q_stream_windows", "q_object_rules", "q_truncated_tail", "q_index_and_end")]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in FILES])
def test_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInArrow", text)


@pytest.mark.parametrize("name", ["q_roundtrip_symbols", "q_index_and_end", "q_roundtrip_rows"])
def test_plan_through_files(spark, name):
    """Python reads files there, but nothing is paired row by row."""
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name,columns", [("q_physical", {"event_id", "value"}), ("q_blob_sizes", {"text", "source"}), ("q_homogeneous", {"l_orderkey", "l_returnflag", "l_linestatus"}), ("q_end_totals", {"conv_id", "role"})])
def test_scans_read_what_they_need(spark, name, columns):
    (schema,) = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SF)))
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_filters_reach_the_scan(spark):
    frame = QUERIES["q_long_form"](spark, SF).where("l_orderkey = 7")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_orderkey,7\)", plan(frame))


@pytest.mark.parametrize("name", ["q_delta_encode", "q_delta_decode_64", "q_xor_decode", "q_counter_unwrap", "q_sequence_gaps", "q_record_offsets", "q_sessions", "q_clock_interpolation"])
def test_lanes_are_split(spark, name):
    """The windows that give the result are partitioned by lane and stretch."""
    last = re.search(r"\n[ :+-]*Window \[.*\], \[([^\]]*)\], \[[^\]]*\]", plan(QUERIES[name](spark, SF)))
    assert "_stretch" in last[1]
