import pytest

from daqframe.llm.queries import oracle_sql, queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_quality_classifier": "doc_id held_out score predicted",
    "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_near_duplicates": "doc_id n_shingles component_id kept",
    "op6_byte_level_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_nearest_neighbours": "query_id rank vec_id score",
    "op10_substring_dedup": "doc_id n_words n_removed kept_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    frame = queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    if name in oracle_sql():
        compare(frame, oracle_sql()[name], SF)
    else:
        assert frame.count() >= {"op9_nearest_neighbours": 10}.get(name, 200)
