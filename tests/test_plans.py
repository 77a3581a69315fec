"""Physical plan checks: no Cartesian product, no Python UDF on the relational paths."""
from ermine.plans import fixtures as FX
from ermine.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_and_assembly_plans_stay_jvm_side(spark):
    for key in ["r17_rule_hits", "r15_rule_hits", "a1_doc_model_rels", "a7_a10_part_model_rels", "e5_rel_scores_exact"]:
        p = _plan(QUERIES[key](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key


def test_token_scan_prunes_columns(spark):
    df = FX.corpus(spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in p.split("ReadSchema:")[1].split("\n")[0]
