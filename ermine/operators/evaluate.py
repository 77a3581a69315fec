"""Scoring predicted models against truth models, as joins and grouped counts.

Inputs are the consolidated tables of ``assemble`` (or any tables with the same
columns).  Every score is per ``model``, of either side; a model without a class on
one side is the null model there (scores 0, 0, 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import placed


def _f1(p, r):
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("model").agg(F.count(F.lit(1)).alias(name))


def pair_count(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Number of (predicted, true) pairs that agree on ``keys`` per model (pairs, not distinct rows)."""
    p = pred.groupBy("model", *keys).agg(F.count(F.lit(1)).alias("_np"))
    t = truth.groupBy("model", *keys).agg(F.count(F.lit(1)).alias("_nt"))
    return p.join(t, ["model", *keys]).groupBy("model").agg(
        F.sum(F.col("_np") * F.col("_nt")).alias("pairs"))


def pairing(pred_classes: DataFrame, true_classes: DataFrame) -> DataFrame:
    """Models on both sides (full outer), so a missing side is visible."""
    return (_counts(pred_classes, "n_pred").join(_counts(true_classes, "n_true"), "model", "full")
            .select("model", F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
                    F.coalesce("n_true", F.lit(0)).alias("n_true")))


def class_scores(pred_classes: DataFrame, true_classes: DataFrame, keys=("class_name",),
                 target: str = "classes") -> DataFrame:
    """Precision / recall / F1 of classes that agree on ``keys``, per model of either side."""
    j = pairing(pred_classes, true_classes).join(pair_count(pred_classes, true_classes, list(keys)), "model", "left")
    pairs = F.coalesce("pairs", F.lit(0)).cast("double")
    prec = F.when(F.col("n_pred") > 0, pairs / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("n_true") > 0, pairs / F.col("n_true")).otherwise(0.0)
    return j.select("model", F.lit(target).alias("target"), prec.alias("precision"), rec.alias("recall")) \
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def class_signatures(classes: DataFrame, attributes: DataFrame, typed: bool = True) -> DataFrame:
    """Classes with ``attrs``, the list of their (name, type) or names in order.

    The list is one class's own, so it is as long as that class has attributes."""
    a = F.struct("attr_name", "attr_type") if typed else F.col("attr_name")
    lists = attributes.groupBy("model", "class_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("first_ord").alias("o"), a.alias("a")))), lambda x: x["a"])
        .alias("attrs"))
    none = F.array().cast(lists.schema["attrs"].dataType)
    return classes.join(lists, ["model", "class_name"], "left").withColumn("attrs", F.coalesce("attrs", none))


def signature_scores(pred_classes: DataFrame, pred_attributes: DataFrame, true_classes: DataFrame,
                     true_attributes: DataFrame, typed: bool = True) -> DataFrame:
    """E3 (typed) / E4: class scores where the name and the ordered attributes, with or without types, must agree."""
    return class_scores(class_signatures(pred_classes, pred_attributes, typed),
                        class_signatures(true_classes, true_attributes, typed), ("class_name", "attrs"),
                        "classes_exact" if typed else "classes_untyped")


def relation_scores(pred_classes: DataFrame, pred_rels: DataFrame, true_classes: DataFrame,
                    true_rels: DataFrame, relaxed: bool = False) -> DataFrame:
    """E5 (exact: src, dst, name, multiplicity) / E6 (relaxed: src, dst) pair-count scores.

    Both sides empty -> 1; a predicted side empty with true relations -> 0; the
    null model -> 0, 0, 0.  Pair counting can push relaxed scores above 1.
    """
    keys = ["src", "dst"] if relaxed else ["src", "dst", "rel_name", "mult"]
    j = (_counts(true_classes, "_tc").join(_counts(pred_classes, "_pc"), "model", "full")
         .join(_counts(pred_rels, "n_pred"), "model", "left").join(_counts(true_rels, "n_true"), "model", "left")
         .join(pair_count(pred_rels, true_rels, keys), "model", "left"))
    npred, ntrue = F.coalesce("n_pred", F.lit(0)), F.coalesce("n_true", F.lit(0))
    pairs = F.coalesce("pairs", F.lit(0)).cast("double")
    null_model = F.col("_pc").isNull() | F.col("_tc").isNull()
    prec = (F.when(null_model, 0.0).when(npred > 0, pairs / npred)
            .when(ntrue != 0, 0.0).otherwise(1.0))
    rec = F.when(null_model, 0.0).when(ntrue > 0, pairs / ntrue).otherwise(1.0)
    tgt = "rels_relaxed" if relaxed else "rels_exact"
    return j.select("model", F.lit(tgt).alias("target"), prec.alias("precision"), rec.alias("recall")) \
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def size_similarity(pred_classes: DataFrame, pred_rels: DataFrame, true_classes: DataFrame,
                    true_rels: DataFrame) -> DataFrame:
    """1 - distance of the unit vectors (nodes, edges) of the two model graphs."""
    j = (_counts(true_classes, "gn").join(_counts(pred_classes, "pn"), "model", "full")
         .join(_counts(true_rels, "ge"), "model", "left").join(_counts(pred_rels, "pe"), "model", "left"))
    gn, ge = F.coalesce("gn", F.lit(0)).cast("double"), F.coalesce("ge", F.lit(0)).cast("double")
    pn, pe = F.coalesce("pn", F.lit(0)).cast("double"), F.coalesce("pe", F.lit(0)).cast("double")
    gnorm, pnorm = F.sqrt(gn * gn + ge * ge), F.sqrt(pn * pn + pe * pe)
    d = F.sqrt(F.pow(pn / pnorm - gn / gnorm, 2) + F.pow(pe / pnorm - ge / gnorm, 2))
    return j.select("model", F.when((pnorm > 0) & (gnorm > 0), 1 - d).alias("size_similarity"))


def graph_degrees(classes: DataFrame, rels: DataFrame) -> DataFrame:
    """Node table with multigraph degree; a self loop counts once, as in the adjacency."""
    ends = rels.select("model", F.explode(F.array_distinct(F.array("src", "dst"))).alias("class_name"))
    deg = ends.groupBy("model", "class_name").agg(F.count(F.lit(1)).alias("degree"))
    return classes.select("model", "class_name").join(deg, ["model", "class_name"], "left") \
        .select("model", "class_name", F.coalesce("degree", F.lit(0)).alias("degree"))


def integrity_violations(classes: DataFrame, rels: DataFrame) -> DataFrame:
    """Duplicate class names, duplicate (src, dst, mult, name) associations."""
    dc = (classes.groupBy("model", "class_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
          .select("model", F.lit("duplicate class").alias("violation"), F.col("class_name").alias("item"), "n"))
    dr = (rels.groupBy("model", "src", "dst", "mult", "rel_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
          .select("model", F.lit("duplicate association").alias("violation"),
                  F.concat_ws(" ", "src", "dst", "mult", "rel_name").alias("item"), "n"))
    return dc.unionByName(dr)


def score_summary(scores: DataFrame) -> DataFrame:
    """Unweighted means over models per target."""
    return scores.groupBy("target").agg(F.avg("precision").alias("mean_precision"),
                                        F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"),
                                        F.count(F.lit(1)).alias("n_models"))


# ---- whole comparisons ------------------------------------------------------------------------------

def structural_equality(pred: tuple[DataFrame, DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame, DataFrame],
                        strict: bool = False) -> DataFrame:
    """(model, n_pred, n_true, equal).  Models are equal if they have as many classes, and those of one place have the
    same name, kind and attributes (kind ``class``) or associations (other kinds), in order.

    Lists are compared as far as the shorter goes; ``strict`` wants them equally long.
    """
    def listed(model):
        classes, attributes, rels = model
        c = placed(class_signatures(classes, attributes), "model", ["first_ord"], "place")
        links = rels.groupBy("model", F.col("src").alias("class_name")).agg(F.transform(F.array_sort(F.collect_list(
            F.struct(F.col("first_ord").alias("o"), F.struct("dst", "mult", "rel_name").alias("r")))), lambda x: x["r"])
            .alias("links"))
        c = c.join(links, ["model", "class_name"], "left")
        return c.select("model", "place", F.struct(
            "class_name", "kind", "attrs", F.coalesce("links", F.array().cast(links.schema["links"].dataType))
            .alias("links")).alias("c"))

    p, t = listed(pred).withColumnRenamed("c", "p"), listed(truth).withColumnRenamed("c", "t")
    j = p.join(t, ["model", "place"], "full")

    def same(name):
        a, b = F.col(f"p.{name}"), F.col(f"t.{name}")
        if strict:
            return a.eqNullSafe(b)
        n = F.least(F.size(a), F.size(b))
        return F.slice(a, 1, n).eqNullSafe(F.slice(b, 1, n))

    both = F.col("p").isNotNull() & F.col("t").isNotNull()
    equal = (F.col("p.class_name").eqNullSafe(F.col("t.class_name")) & F.col("p.kind").eqNullSafe(F.col("t.kind"))
             & F.when(F.col("p.kind") == "class", same("attrs")).otherwise(same("links")))
    return j.groupBy("model").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"),
                                  F.bool_and(F.when(both, equal).otherwise(F.lit(False))).alias("equal"))


def assembly_report(equality: DataFrame) -> DataFrame:
    """(model, status, n_pred, n_true): passed and failed models with the classes predicted and true."""
    return equality.select("model", F.when(F.col("equal"), "passed").otherwise("failed").alias("status"), "n_pred", "n_true")


def semantic_comparison(pred: tuple[DataFrame, DataFrame, DataFrame], truth: tuple[DataFrame, DataFrame, DataFrame],
                        key: list[str]) -> DataFrame:
    """(key, same) for the fragments of both sides, from fragment tables.

    Classes of one place, as far as both sides have them, agree in lower-case name and in their attributes' names in order;
    and every predicted relation equals every true one.  That holds if a side has none, or if all relations of both
    are one and the same: so the distinct ones are counted, never paired.  Both sides have rows for most sentences, so they
    are merged by key: a broadcast, chosen by the size of a packed file, would hold them in the driver.
    """
    def classes(side):
        c, a, _ = side
        names = a.groupBy(*key, "class_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("attr_pos", "attr_name"))),
                                                              lambda x: x["attr_name"]).alias("names"))
        c = c.join(names.hint("merge"), [*key, "class_name"], "left")
        sig = F.struct(F.lower("class_name").alias("name"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
        return c.groupBy(*key, "class_pos").agg(F.min(sig).alias("sig"))

    p, t = classes(pred).withColumnRenamed("sig", "p"), classes(truth).withColumnRenamed("sig", "t")
    c = p.join(t.hint("merge"), [*key, "class_pos"]).groupBy(*key).agg(F.bool_and(F.col("p") == F.col("t")).alias("classes"))
    rel = F.struct("dst", "mult", "rel_name").alias("r")
    r = (pred[2].select(*key, rel, F.lit(1).alias("p"), F.lit(0).alias("t"))
         .unionByName(truth[2].select(*key, rel, F.lit(0).alias("p"), F.lit(1).alias("t"))))
    r = r.groupBy(*key).agg((F.sum("p") > 0).alias("p"), (F.sum("t") > 0).alias("t"),
                            (F.min("r") == F.max("r")).alias("one"))
    asked = pred[0].select(*key).distinct().join(truth[0].select(*key).distinct().hint("merge"), key)
    j = asked.join(c.hint("merge"), key, "left").join(r.hint("merge"), key, "left")
    rels = ~(F.coalesce("p", F.lit(False)) & F.coalesce("t", F.lit(False))) | F.col("one")
    return j.select(*key, (F.coalesce("classes", F.lit(True)) & rels).alias("same"))


def semantics_status(asked: DataFrame, comparison: DataFrame, key: list[str]) -> DataFrame:
    """E14, the lists: every sentence asked with ``status``: passed, wrong, or failed where nothing was compared."""
    status = F.when(F.col("same").isNull(), "failed").when(F.col("same"), "passed").otherwise("wrong")
    return asked.join(comparison.hint("merge"), key, "left").select(*asked.columns, status.alias("status"))


def semantics_report(status: DataFrame) -> DataFrame:
    """E14, the counts: (kind, status, n) with totals by kind, by status and of all, as nulls."""
    return status.cube("kind", "status").agg(F.count(F.lit(1)).alias("n"))
