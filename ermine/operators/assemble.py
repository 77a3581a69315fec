"""Consolidate fragments into one model per ``model`` key, as set-based aggregates.

The greedy, fragment-at-a-time merge of the original becomes hash aggregates
keyed by ``(model, class ...)`` plus equi-joins.  Order still decides a few
outcomes (first spelling, first non-null type, first non-empty multiplicity);
it is resolved with ``min_by`` over one order struct, so no window over a whole
model and no collect of a model into one task: a huge model spreads over its
class keys and every aggregate combines map-side first.

The order struct is (phase, seq, pos): class fragments come first (A2), then
relation fragments, each by ``seq``, then by position inside the fragment.
``seq`` may be of any orderable type, a struct of keys too, and so may ``model``.
Groups have the names before the model: the first of their columns is what their
rows are sorted by at once, and models are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_first

CLASS_PHASE, REL_PHASE = 0, 1


def order(phase: int, pos: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), F.col("seq"), pos.cast("int").alias("pos"))


# ---- A11 builder API: column constructors for the three fragment tables -------

def fragment_class_rows(df: DataFrame, model: str, seq: str, class_name: str, class_pos: int = 0,
                        kind: str = "class") -> DataFrame:
    return df.select(F.col(model).alias("model"), F.col(seq).alias("seq"),
                     F.lit(class_pos).alias("class_pos"), F.col(class_name).alias("class_name"),
                     F.lit(kind).alias("kind"))


def fragment_attribute_rows(df: DataFrame, model: str, seq: str, class_name: str, attr_name: str,
                            attr_type: str | None, attr_pos: int = 0) -> DataFrame:
    t = F.col(attr_type) if attr_type else F.lit(None).cast("string")
    return df.select(F.col(model).alias("model"), F.col(seq).alias("seq"),
                     F.col(class_name).alias("class_name"), F.lit(attr_pos).alias("attr_pos"),
                     F.col(attr_name).alias("attr_name"), t.alias("attr_type"))


def fragment_rel_rows(df: DataFrame, model: str, seq: str, src: str, dst: str, mult: str | None = None,
                      rel_name: str | None = None) -> DataFrame:
    return df.select(F.col(model).alias("model"), F.col(seq).alias("seq"),
                     F.col(src).alias("src"), F.col(dst).alias("dst"),
                     (F.col(mult) if mult else F.lit("")).alias("mult"),
                     (F.col(rel_name) if rel_name else F.lit("")).alias("rel_name"))


def canonical_classes(fragment_classes: DataFrame) -> DataFrame:
    """A3 + A4: classes of class fragments, merged by lower-case name; first spelling wins."""
    cf = fragment_classes.filter(F.col("kind") == "class")
    o = order(CLASS_PHASE, F.col("class_pos"))
    return (cf.withColumn("lname", F.lower("class_name")).withColumn("ord", o)
            .groupBy("lname", "model")
            .agg(F.min_by("class_name", "ord").alias("class_name"), F.min("ord").alias("first_ord"))
            .select("model", "lname", "class_name", "first_ord"))


def partial_attributes(fragment_attributes: DataFrame) -> DataFrame:
    """A5: per class (lower-case name) and attribute the first non-null type, and ``type_ord``, where it stood."""
    typed = F.when(F.col("attr_type").isNotNull(), F.col("ord"))
    return (fragment_attributes.withColumn("lname", F.lower("class_name"))
            .withColumn("ord", order(CLASS_PHASE, F.col("attr_pos")))
            .groupBy("attr_name", "lname", "model")
            .agg(F.min_by("attr_type", typed).alias("attr_type"), F.min(typed).alias("type_ord"),
                 F.min("ord").alias("first_ord"))
            .select("model", "lname", "attr_name", "attr_type", "type_ord", "first_ord"))


def owned(partial: DataFrame, canon: DataFrame) -> DataFrame:
    """Attributes with the class they belong to, in its canonical spelling."""
    names = canon.select("model", "lname", F.col("class_name").alias("owner"))
    return partial.drop("type_ord").join(names, ["model", "lname"]).drop("lname")


def promotions(attrs: DataFrame, canon: DataFrame) -> DataFrame:
    """Attributes named like another class of the model -> (model, owner, attr_name, target)."""
    c = canon.select("model", F.col("lname").alias("t_lname"), F.col("class_name").alias("target"))
    j = attrs.join(c, (attrs.model == c.model) & (F.lower(attrs.attr_name) == c.t_lname))
    return j.filter(F.lower(F.col("owner")) != F.col("t_lname")).select(
        attrs.model, "owner", "attr_name", "target", "first_ord")


def merged_relations(fragment_rels: DataFrame) -> DataFrame:
    """A10 on relation fragments: one row per (src, dst, name); ``mult_ord`` is where a multiplicity first stood."""
    o = order(REL_PHASE, F.lit(0))
    stated = F.when(F.col("mult") != "", F.col("ord"))
    return (fragment_rels.withColumn("ord", o).groupBy("src", "dst", "rel_name", "model")
            .agg(F.min_by("mult", stated).alias("mult"), F.min(stated).alias("mult_ord"),
                 F.min("ord").alias("first_ord"))
            .select("model", "src", "dst", "rel_name", "mult", "mult_ord", "first_ord"))


def consolidate(canon: DataFrame, attrs: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A6 + A7 + A10 over classes, attributes and relations that are merged already, one row a key."""
    prom = promotions(attrs, canon)
    kept = attrs.join(prom.select("model", "owner", "attr_name"), ["model", "owner", "attr_name"], "left_anti")
    model_attributes = kept.select("model", F.col("owner").alias("class_name"), "attr_name", "attr_type",
                                   "first_ord")
    promoted = prom.select("model", F.col("owner").alias("src"), F.col("target").alias("dst"),
                           lower_first(F.col("target")).alias("rel_name"), F.lit(None).cast("string").alias("mult"),
                           F.lit(None).cast(rels.schema["mult_ord"].dataType).alias("mult_ord"), "first_ord")
    # Endpoints matched by exact name, missing ones become classes
    end = rels.select("model", F.explode(F.array(
        F.struct(F.col("src").alias("class_name"), F.col("first_ord").alias("ord")),
        F.struct(F.col("dst").alias("class_name"), F.col("first_ord").withField("pos", F.lit(1)).alias("ord")))).alias("e"))
    ends = end.groupBy("e.class_name", "model").agg(F.min("e.ord").alias("first_ord")).select("model", "class_name", "first_ord")
    new_classes = ends.join(canon.select("model", "class_name"), ["model", "class_name"], "left_anti")
    model_classes = (canon.select("model", "class_name", "first_ord").unionByName(new_classes)
                     .withColumn("kind", F.lit("class")).select("model", "class_name", "kind", "first_ord"))
    # A10: one relation per (src, dst, name), the promoted ones among them; the first non-empty multiplicity wins
    model_rels = (rels.unionByName(promoted).groupBy("src", "dst", "rel_name", "model")
                  .agg(F.coalesce(F.min_by("mult", "mult_ord"), F.lit("")).alias("mult"),
                       F.min("first_ord").alias("first_ord"))
                  .select("model", "src", "dst", "rel_name", "mult", "first_ord"))
    return model_classes, model_attributes, model_rels


def assemble(fragment_classes: DataFrame, fragment_attributes: DataFrame, fragment_rels: DataFrame
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A1: fragments -> (model_classes, model_attributes, model_rels), fixed mode.

    model_classes(model, class_name, kind, first_ord)
    model_attributes(model, class_name, attr_name, attr_type, first_ord)
    model_rels(model, src, dst, rel_name, mult, first_ord)
    """
    canon = canonical_classes(fragment_classes)
    return consolidate(canon, owned(partial_attributes(fragment_attributes), canon), merged_relations(fragment_rels))


# ---- merging what was consolidated apart (X2) ------------------------------------------------------

def merge_classes(parts: DataFrame) -> DataFrame:
    """Rows of :func:`canonical_classes` of several batches -> those of all fragments together."""
    return parts.groupBy("model", "lname").agg(F.min_by("class_name", "first_ord").alias("class_name"),
                                               F.min("first_ord").alias("first_ord"))


def merge_attributes(parts: DataFrame) -> DataFrame:
    """The same for :func:`partial_attributes`."""
    return parts.groupBy("model", "lname", "attr_name").agg(
        F.min_by("attr_type", "type_ord").alias("attr_type"), F.min("type_ord").alias("type_ord"),
        F.min("first_ord").alias("first_ord"))


def merge_relations(parts: DataFrame) -> DataFrame:
    """The same for :func:`merged_relations`."""
    return parts.groupBy("model", "src", "dst", "rel_name").agg(
        F.min_by("mult", "mult_ord").alias("mult"), F.min("mult_ord").alias("mult_ord"),
        F.min("first_ord").alias("first_ord"))


def flat(df: DataFrame) -> DataFrame:
    """A table of a model with its order as plain columns: ``first_phase``, ``first_<key of seq>``, ``first_pos``."""
    seq = df.schema["first_ord"].dataType["seq"].dataType
    keys = [f"seq.{f}" for f in seq.fieldNames()] if hasattr(seq, "fieldNames") else ["seq"]
    cols = [F.col(f"first_ord.{k}").alias("first_" + k.split(".")[-1]) for k in ["phase", *keys, "pos"]]
    return df.select(*[c for c in df.columns if c != "first_ord"], *cols)
