"""Registered queries against their DuckDB oracles on the smallest scale."""
import pytest

from ermine.plans.check import compare, duck
from ermine.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
KEYS = ["t1_tokens", "t3_t4_t5_chunk_names", "r14_rule_hits", "r18_r19_selected_fragments", "a1_doc_model_rels",
        "a5_a6_part_model_attributes", "a1_part_model_classes",
        "a7_a10_part_model_rels", "e2_class_scores", "e5_rel_scores_exact", "p2_grouped_texts",
        "p4a_pronoun_antecedents", "c4_c12_c14_bernoulli_predictions", "c12_sentence_kinds", "r21_rule_coverage",
        "r21_unmatched_sentences", "e1_paired_models", "e3_class_scores_exact", "e4_class_scores_untyped",
        "e12_structural_equality", "e13_semantic_comparison", "e14_semantics_status", "e14_semantics_report",
        "e15_assembly_report", "e16_graph_degrees", "e10_fragment_violations", "p6_split_dataset",
        "p4_resolved_sentences"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    r = compare(QUERIES[key](spark, SF), ORACLE[key], SF, con)
    assert r["schema_match"] and r["values_match"], r


def test_every_query_has_oracle_or_is_documented():
    rows_only = {"c7_c11_model_grid"}
    assert set(QUERIES) - set(ORACLE) == rows_only
