"""Rule selection, kind dispatch, fragment tables, integrity and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import priority_df
from .rules import RULES, Rule
from .rules import hits as rule_results

KEY = ["doc_id", "sent_id"]


def all_hits(tokens: DataFrame | None, rules: list[Rule] | None = None, names: DataFrame | None = None,
             pieces: int | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Every rule's per-sentence result (R0d applied per rule).  ``pieces``, ``kept``: see the rules."""
    return rule_results(tokens, names, rules or RULES, pieces, kept)


def _sorted_join(df: DataFrame) -> DataFrame:
    """A side with a row a sentence.  Its file is a small part of its size in memory, so by the file Spark would collect it in the
    driver and broadcast it; where both sides are in buckets of ``doc_id`` the merge takes no exchange."""
    return df.hint("merge")


def dispatch(hits: DataFrame, sentence_kinds: DataFrame) -> DataFrame:
    """Keep the hits of rules whose kind is the sentence's predicted kind."""
    k = sentence_kinds.select(*KEY, F.col("kind").alias("sentence_kind"))
    return hits.join(_sorted_join(k), KEY).filter(F.col("kind") == F.col("sentence_kind")).drop("sentence_kind")


def rejected_kinds(sentence_kinds: DataFrame) -> DataFrame:
    """Sentences whose kind is neither ``class`` nor ``rel``."""
    return sentence_kinds.filter(~F.col("kind").isin("class", "rel") | F.col("kind").isNull())


def select_best(hits: DataFrame, compat: bool = False) -> DataFrame:
    """One hit -> that; several -> fixed priority per kind (broadcast, 17 rows)."""
    spark = hits.sparkSession
    pr = F.broadcast(priority_df(spark, compat).select("rule", "priority"))
    w = W.partitionBy(*KEY)
    h = hits.withColumn("_n", F.count(F.lit(1)).over(w)).join(pr, "rule", "left")
    if compat:
        # one hit wins whatever it is; with several, unlisted rules cannot win
        h = h.filter((F.col("_n") == 1) | F.col("priority").isNotNull())
    h = h.withColumn("_rk", F.row_number().over(w.orderBy(F.col("priority").asc_nulls_last(), "rule")))
    return h.filter("_rk = 1").drop("_n", "_rk", "priority")


def fragments(best: DataFrame, doc_models: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selected hits -> ``fragment_classes``, ``fragment_attributes``, ``fragment_rels``.

    ``doc_models`` maps ``doc_id`` to ``model``; ``seq`` is the struct of both keys, of whatever type they are.
    """
    b = best.join(_sorted_join(doc_models.select("doc_id", "model")), "doc_id")
    # made last: above the explosion of rows its keys are still those that they are dealt out by
    seq = F.struct("doc_id", "sent_id").alias("seq")
    is_cls = F.col("kind") == "class"
    classes = b.select("model", *KEY, F.explode(
        F.when(is_cls, F.array(F.struct(F.lit(0).alias("class_pos"), F.col("cls").alias("class_name"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("class_pos"), F.col("src").alias("class_name")),
                           F.struct(F.lit(1).alias("class_pos"), F.col("dst").alias("class_name"))))).alias("c"),
        "kind").select("model", seq, "c.class_pos", "c.class_name", "kind")
    attrs = (b.filter(is_cls)
             .select("model", *KEY, F.col("cls").alias("class_name"), "attr_type",
                     F.posexplode(F.array("attr1", "attr2", "attr3")).alias("attr_pos", "attr_name"))
             .filter(F.col("attr_name").isNotNull())
             .select("model", seq, "class_name", "attr_pos", "attr_name", "attr_type"))
    rels = b.filter(~is_cls).select("model", seq, "src", "dst", "mult", "rel_name")
    return classes, attrs, rels


def integrity(fragment_classes: DataFrame) -> DataFrame:
    """A class fragment has exactly one class, a relation fragment exactly two."""
    g = fragment_classes.groupBy("model", "seq", "kind").agg(F.count(F.lit(1)).alias("n_classes"))
    expected = F.when(F.col("kind") == "class", 1).otherwise(2)
    return g.filter(F.col("n_classes") != expected)


def coverage(hits: DataFrame, sentence_kinds: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per kind and rule, matched and unmatched sentence counts, with rollup totals."""
    spark = hits.sparkSession
    rules = rules or RULES
    rk = spark.createDataFrame([(r.rid, r.kind) for r in rules], "rule string, kind string")
    total = sentence_kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    hit = dispatch(hits, sentence_kinds).groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("matched"))
    j = rk.join(total, "kind").join(hit, ["kind", "rule"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return j.rollup("kind", "rule").agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"),
                                        F.coalesce(F.sum(F.col("n") - F.col("matched")), F.lit(0)).alias("unmatched"))


def unmatched_sentences(hits: DataFrame, sentence_kinds: DataFrame) -> DataFrame:
    """Sentences of a kind that no rule of that kind matched (anti join)."""
    return sentence_kinds.join(_sorted_join(dispatch(hits, sentence_kinds).select(*KEY)), KEY, "left_anti")
