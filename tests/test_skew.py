"""Queries on tables in which one user, one customer and one part hold a third of the rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import TABLES, compare, duck

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "events": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id",
    "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey",
    "lineitem": "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS l_partkey",
}
NAMES = (
    "w3_row_pattern_repair w4_phrase_grouping w7_melisma_insertion w14_gap_classification w16_subtitle_spans "
    "w23_frame_quantise w28_anchored_fill w35_rolling_quota w36_queue_depth j1_word_row_lookup j2_nearest_pairing "
    "j3_tempo_map_time j7_frames_in_spans j18_beat_snap j28_edit_merge a1_channel_hit_rate a6_modal_pitch "
    "a8_evaluation_report k1_lexicographic_argmin t1_rate_limiter w5_skyline"
).split()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for t in TABLES:
        columns = f"* REPLACE ({HOT[t]})" if t in HOT else "*"
        duckdb.sql(f"COPY (SELECT {columns} FROM '{SOURCE}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, skewed, name):
    _, problems = compare(spark, duck(skewed), entry.queries()[name], entry.oracle_sql()[name], skewed)
    assert not problems
