"""Ecore metamodel files through Spark's XML source, and their diagrams.

A file is one row, its classifiers and features nested arrays with an explicit schema.  Types and opposites are
references into the file, by name (``#//B``, ``#//B/a``) or by place (``//@eClassifiers.2``); the ones by place are
resolved by a join.  Nothing walks an object graph: a pair of opposite references is met once because both have the
same edge key, whatever cycles the model has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import _model_from_path

S, A = T.StringType(), T.ArrayType


def _struct(*names: str, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names] + [T.StructField(n, t) for n, t in more.items()])


FEATURE = _struct("_xsi:type", "_name", "_eType", "_lowerBound", "_upperBound", "_containment", "_eOpposite")
CLASSIFIER = _struct("_xsi:type", "_name", "_interface", "_eSuperTypes", eStructuralFeatures=A(FEATURE),
                     eLiterals=A(_struct("_name", "_value")))
PACKAGE_OF_MODEL = _struct("_name", eClassifiers=A(CLASSIFIER), model=S)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(model, package, pos, c): one row a classifier, in the order of the file; ``model`` is the folder of a layout
    partitioned by it, else the file's name."""
    raw = spark.read.schema(PACKAGE_OF_MODEL).option("rowTag", "ecore:EPackage").format("xml").load(path)
    raw = raw.withColumn("_path", F.input_file_name()).withColumn("model", F.coalesce("model", _model_from_path()))
    return raw.select("model", F.col("_name").alias("package"), F.posexplode("eClassifiers").alias("pos", "c"))


def _features(packages: DataFrame, kind: str) -> DataFrame:
    f = packages.filter(F.col("c.`_xsi:type`") == "ecore:EClass").select(
        "model", "pos", F.col("c._name").alias("class_name"), F.posexplode("c.eStructuralFeatures").alias("feature_pos", "f"))
    return f.filter(F.col("f.`_xsi:type`") == f"ecore:{kind}")


def _target(c: Column) -> Column:
    """What stands after ``#//`` or, by place, ``//``: ``B``, ``B/a``, ``@eClassifiers.2``; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"//([^/]+(?:/[^/]+)?)$", 1), F.lit(""))


def _resolved(df: DataFrame, packages: DataFrame, name: str) -> DataFrame:
    """Column ``name`` with places replaced by the names of the classifiers there."""
    at = packages.select("model", F.col("pos").alias("_pos"), F.col("c._name").alias("_name"))
    place = F.expr(f"try_cast(regexp_extract({name}, '^@eClassifiers\\\\.(\\\\d+)$', 1) AS int)")
    return (df.withColumn("_pos", place).join(at, ["model", "_pos"], "left")
            .withColumn(name, F.coalesce("_name", name)).drop("_pos", "_name"))


def read_ecore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ecore files -> (classes, attributes, references), every reference kept.

    classes(model, class_pos, class_name), attributes(model, class_name, attr_pos, attr_name, attr_type),
    references(model, class_pos, ref_pos, src, dst, mult, rel_name, containment, opposite).  Enums and data types are no classes.
    ``mult`` is ``lower..upper``, ``*`` where many; bounds left out are 0 and 1.
    """
    p = read_packages(spark, path)
    classes = p.filter(F.col("c.`_xsi:type`") == "ecore:EClass").select(
        "model", F.col("pos").alias("class_pos"), F.col("c._name").alias("class_name"))
    attributes = _features(p, "EAttribute").select(
        "model", "class_name", F.col("feature_pos").alias("attr_pos"), F.col("f._name").alias("attr_name"),
        _target(F.col("f._eType")).alias("attr_type"))
    lower, upper = F.coalesce("f._lowerBound", F.lit("0")), F.coalesce("f._upperBound", F.lit("1"))
    many = (upper.cast("int") < 0) | (upper.cast("int") > 1)
    refs = _features(p, "EReference").select(
        "model", F.col("pos").alias("class_pos"), F.col("feature_pos").alias("ref_pos"), F.col("class_name").alias("src"),
        _target(F.col("f._eType")).alias("dst"), F.concat(lower, F.lit(".."), F.when(many, "*").otherwise(upper)).alias("mult"),
        F.col("f._name").alias("rel_name"), F.coalesce(F.col("f._containment") == "true", F.lit(False)).alias("containment"),
        F.split_part(_target(F.col("f._eOpposite")), F.lit("/"), F.lit(2)).alias("opposite"))
    return classes, _resolved(attributes, p, "attr_type"), _resolved(refs, p, "dst")


def last_reference(references: DataFrame) -> DataFrame:
    """S4a, as the original has it: one association a model, the last reference of the file."""
    cols = [c for c in references.columns if c != "model"]
    return references.groupBy("model").agg(F.max_by(F.struct(*cols), F.struct("class_pos", "ref_pos")).alias("r")) \
        .select("model", "r.*")


def ecore_lines(spark: SparkSession, path: str, theme: str = "plain") -> DataFrame:
    """S8 rows: the diagram of every file, (model, k0, k1, k2, k3, line) with the sort key of ``write_plantuml``.

    Each classifier has its block, super types and references; of two opposite references the first of the file stands
    for both.
    """
    p = read_packages(spark, path)
    _, attributes, refs = read_ecore(spark, path)
    place = F.col("pos").cast("long")

    def rows(df, k0, k1, k2, k3, line):
        return df.select("model", F.lit(k0).alias("k0"), k1.cast("long").alias("k1"), F.lit(k2).alias("k2"),
                         k3.cast("long").alias("k3"), line.alias("line"))

    zero, name = F.lit(0), F.col("c._name")
    kind = F.col("c.`_xsi:type`")
    head = p.groupBy("model").agg(F.first("package").alias("package"))
    cls, enum = p.filter(kind == "ecore:EClass"), p.filter(kind == "ecore:EEnum")
    word = F.when(F.col("c._interface") == "true", "interface ").otherwise("class ")
    at = p.select("model", F.col("pos"), name.alias("class_name"))
    supers = cls.select("model", "pos", name.alias("class_name"), F.posexplode(
        F.split(F.coalesce("c._eSuperTypes", F.lit("")), r"\s+")).alias("k", "ref"))
    supers = _resolved(supers.withColumn("super", _target(F.col("ref"))), p, "super").filter(F.col("super").isNotNull())
    # an edge's key is the same seen from both ends
    own, other = F.struct(F.col("src").alias("c"), F.col("rel_name").alias("n")), F.struct(
        F.col("dst").alias("c"), F.col("opposite").alias("n"))
    alone = F.struct(F.col("src").alias("c"), F.concat_ws(" ", "rel_name", F.col("ref_pos").cast("string")).alias("n"))
    edge = F.when(F.col("opposite").isNull(), F.array(alone)).otherwise(F.array_sort(F.array(own, other)))
    side = F.struct("class_pos", "ref_pos", "src", "dst", "mult", "rel_name", "containment", "opposite")
    pair = refs.withColumn("edge", edge).groupBy("model", "edge").agg(F.min(side).alias("a"), F.max(side).alias("b"))
    both = F.col("a.opposite").isNotNull() & (F.col("a.ref_pos") != F.col("b.ref_pos")) | (
        F.col("a.opposite").isNotNull() & (F.col("a.class_pos") != F.col("b.class_pos")))
    label = lambda x: F.concat(F.lit('"'), F.col(f"{x}.rel_name"), F.lit(" "), F.col(f"{x}.mult"), F.lit('"'))
    star = lambda x: F.when(F.col(f"{x}.containment"), "*").otherwise("")
    link = F.when(both, F.concat(star("a"), F.lit("--"), star("b"), F.lit(" "), label("b"))).otherwise(
        F.concat(star("a"), F.lit("-->")))
    ref_line = F.concat_ws(" ", F.col("a.src"), label("a"), link, F.col("a.dst"))
    literals = enum.select("model", "pos", F.posexplode("c.eLiterals").alias("k", "x"))
    attrs = attributes.join(at, ["model", "class_name"])
    typed = F.concat(F.lit("\t "), F.col("attr_name"), F.lit(" : "), F.coalesce("attr_type", F.lit("None")))
    return reduce(DataFrame.unionByName, [
        rows(head, 0, zero, 0, zero, F.lit("@startuml")),
        rows(head, 0, zero, 1, zero, F.lit(f"!theme {theme}")),
        rows(head, 0, zero, 2, zero, F.concat(F.lit("package "), F.col("package"), F.lit(" {"))),
        rows(cls, 1, place, 0, zero, F.concat(word, name, F.lit(" {"))),
        rows(attrs, 1, place, 1, F.col("attr_pos"), typed),
        rows(cls, 1, place, 2, zero, F.lit("}")),
        rows(supers, 1, place, 3, F.col("k"), F.concat(F.col("super"), F.lit(" <|-- "), F.col("class_name"))),
        rows(pair, 1, F.col("a.class_pos"), 4, F.col("a.ref_pos"), ref_line),
        rows(enum, 1, place, 0, zero, F.concat(F.lit("enum "), name, F.lit(" {"))),
        rows(literals, 1, place, 1, F.col("k"), F.col("x._name")),
        rows(enum, 1, place, 2, zero, F.lit("}")),
        rows(p.filter(kind == "ecore:EDataType"), 1, place, 0, zero,
             F.concat(F.lit("class "), name, F.lit(" << (D,orchid) EDataType>>"))),
        rows(head, 2, zero, 0, zero, F.lit("}")),
        rows(head, 2, zero, 1, zero, F.lit("@enduml")),
    ])


# ---- writing -------------------------------------------------------------------------------------

def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\n", "&#10;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ecore_text(classes: DataFrame, attributes: DataFrame, rels: DataFrame) -> DataFrame:
    """The model tables of A1 as Ecore files: (model, k0, k1, k2, k3, line), for ``write_plantuml``.

    A type is a data type's name; a multiplicity ``l..u`` gives the bounds, an empty one none."""
    order_type = classes.schema["first_ord"].dataType
    block = classes.select("model", "class_name", F.col("first_ord").alias("k1"))
    none = F.lit(None).cast(order_type)

    def rows(df, k0, k1, k2, k3, line):
        return df.select("model", F.lit(k0).alias("k0"), k1.alias("k1"), F.lit(k2).alias("k2"), k3.alias("k3"), line.alias("line"))

    def attr(name, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), c, F.lit('"'))).otherwise("")

    feature = lambda kind, *more: F.concat(
        F.lit(f'    <eStructuralFeatures xsi:type="ecore:{kind}"'), *more, F.lit("/>"))
    lower, upper = (F.nullif(F.split_part("mult", F.lit(".."), F.lit(i)), F.lit("")) for i in (1, 2))
    head = classes.select("model").distinct()
    a = attributes.join(block, ["model", "class_name"])
    r = rels.join(block.withColumnRenamed("class_name", "src"), ["model", "src"])
    return reduce(DataFrame.unionByName, [
        rows(head, 0, none, 0, none, F.concat(
            F.lit('<ecore:EPackage xmi:version="2.0" xmlns:xmi="http://www.omg.org/XMI" '
                  'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
                  'xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore" name="'), _xml(F.col("model")), F.lit('">'))),
        rows(block, 1, F.col("k1"), 0, none, F.concat(
            F.lit('  <eClassifiers xsi:type="ecore:EClass" name="'), _xml(F.col("class_name")), F.lit('">'))),
        rows(a, 1, F.col("k1"), 1, F.col("first_ord"), feature(
            "EAttribute", attr("name", _xml(F.col("attr_name"))), attr("eType", F.concat(F.lit("#//"), _xml(F.col("attr_type")))))),
        rows(r, 1, F.col("k1"), 2, F.col("first_ord"), feature(
            "EReference", attr("name", _xml(F.col("rel_name"))), attr("eType", F.concat(F.lit("#//"), _xml(F.col("dst")))),
            attr("lowerBound", lower), attr("upperBound", F.when(upper == "*", "-1").otherwise(upper)))),
        rows(block, 1, F.col("k1"), 3, none, F.lit("  </eClassifiers>")),
        rows(head, 2, none, 0, none, F.lit("</ecore:EPackage>")),
    ])
