"""Readers and writers of corpus tables, model files and diagram text.

All readers take explicit schemas; model files become the three flat tables
(classes, attributes, relations) keyed by ``model`` (taken from the file name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import MULT_ARROWS

S = T.StringType()
B = T.BooleanType()
MEMBER = T.StructType([T.StructField("name", S), T.StructField("isStatic", B), T.StructField("accessor", S),
                       T.StructField("type", S)])
_ELEM_FIELDS = [
    T.StructField("type", S), T.StructField("name", S), T.StructField("title", S), T.StructField("isAbstract", B),
    T.StructField("members", T.ArrayType(MEMBER)), T.StructField("extends_", T.ArrayType(S)),
    T.StructField("implements_", T.ArrayType(S)), T.StructField("generics", T.ArrayType(S)),
    T.StructField("stereotypes", T.ArrayType(S)), T.StructField("left", S), T.StructField("right", S),
    T.StructField("leftType", S), T.StructField("rightType", S), T.StructField("leftArrowHead", S),
    T.StructField("rightArrowHead", S), T.StructField("leftArrowBody", S), T.StructField("rightArrowBody", S),
    T.StructField("leftCardinality", S), T.StructField("rightCardinality", S), T.StructField("label", S),
    T.StructField("hidden", B)]
INNER_ELEMENT = T.StructType(_ELEM_FIELDS)
ELEMENT = T.StructType(_ELEM_FIELDS + [T.StructField("elements", T.ArrayType(INNER_ELEMENT))])
MODEL_JSON = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT))])

LABELS_SCHEMA = "id BIGINT, fragment_id BIGINT, label STRING"
FRAGMENTS_SCHEMA = "unique_id BIGINT, model STRING, kind STRING, number INT"
KINDS_SCHEMA = "label_id BIGINT, english STRING, kind STRING"


def _model_from_path(c="_path"):
    """File stem without extension; fragment files ``{model}_{class|rel}{n}`` map to their model."""
    stem = F.regexp_extract(F.col(c), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.regexp_replace(stem, r"_(class|rel)\d+.*$", "")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV with an explicit schema (an index column is just a named key column)."""
    return spark.read.schema(schema).option("header", header).option("multiLine", True) \
        .option("escape", '"').csv(path)


def read_json_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """S3: JSON model files -> (classes, attributes, relations, rejected).

    classes(model, class_pos, class_name), attributes(model, class_name, attr_pos, attr_name, attr_type),
    relations(model, rel_pos, src, dst, mult, rel_name), rejected(model, rel_pos, leftCardinality).
    """
    raw = (spark.read.schema(MODEL_JSON).option("multiLine", True).json(path)
           .withColumn("_path", F.input_file_name()).withColumn("model", _model_from_path()))
    first = F.col("elements")[0]
    # Package wrapper -> inner elements, else the bare list
    bare = F.transform("elements", lambda e: e.dropFields("elements"))
    elems = F.when(first["type"].isNotNull() & first["elements"].isNotNull(), first["elements"]).otherwise(bare)
    e = raw.select("model", F.size(elems).alias("n_elems"), F.posexplode(elems).alias("pos", "e"))
    declared = e.filter(F.col("e.name").isNotNull()).select("model", F.col("pos").alias("class_pos"),
                                                            F.col("e.name").alias("class_name"), "e.members")
    attributes = declared.select("model", "class_name", F.posexplode_outer("members").alias("attr_pos", "m")) \
        .filter(F.col("m").isNotNull()) \
        .select("model", "class_name", "attr_pos", F.col("m.name").alias("attr_name"),
                F.col("m.type").alias("attr_type"))
    rels = e.filter(F.col("e.name").isNull() & F.col("e.left").isNotNull()).select(
        "model", F.col("pos").alias("rel_pos"), F.col("e.left").alias("src"), F.col("e.right").alias("dst"),
        F.col("e.leftCardinality").alias("card"), "n_elems")
    # S3d: cardinality split
    words = F.when(F.trim(F.coalesce("card", F.lit(""))) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(F.trim("card"), r"\s+"))
    n = F.size(words)
    w0 = F.element_at(words, 1)
    alpha = w0.rlike(r"^\p{L}+$")
    rels = rels.withColumns({
        "rel_name": F.when(n == 0, "").when(n == 1, F.when(alpha, w0).otherwise(""))
        .when(n == 2, w0),
        "mult": F.when(n == 0, "").when(n == 1, F.when(alpha, "").otherwise(w0))
        .when(n == 2, F.element_at(words, 2)),
    })
    rejected = rels.filter(F.col("rel_name").isNull()).select("model", "rel_pos", F.col("card").alias(
        "leftCardinality"))
    relations = rels.filter(F.col("rel_name").isNotNull())
    # Endpoints not declared as classes become classes, after the declared ones, in order
    place = F.col("n_elems") + F.col("rel_pos") * 2   # a relation stands at a place below the number of elements
    ends = relations.select("model", F.explode(F.array(
        F.struct(F.col("src").alias("class_name"), place.alias("o")),
        F.struct(F.col("dst").alias("class_name"), (place + 1).alias("o")))).alias("x"))
    implied = (ends.groupBy("model", "x.class_name").agg(F.min("x.o").alias("class_pos"))
               .join(declared.select("model", "class_name"), ["model", "class_name"], "left_anti")
               .select("model", "class_pos", "class_name"))
    classes = declared.select("model", "class_pos", "class_name").unionByName(implied)
    return classes, attributes, relations.drop("card", "n_elems"), rejected


def plantuml_lines(classes: DataFrame, attributes: DataFrame, rels: DataFrame, theme: str = "plain") -> DataFrame:
    """S7 rows: (model, k0, k1, k2, k3, line) with a sort key; one block per class then its associations."""
    head = classes.select("model").distinct()
    arrow = F.coalesce(*[F.when(F.col("mult") == code, F.lit(a)) for code, a in MULT_ARROWS], F.lit("-->"))
    block = classes.select("model", "class_name", F.col("first_ord").alias("k1"))
    order_type = classes.schema["first_ord"].dataType

    def at(k0: int, k2: int, k1=None, k3=None):
        none = F.lit(None)
        return [F.lit(k0).alias("k0"), (none.cast(order_type) if k1 is None else k1).alias("k1"), F.lit(k2).alias("k2"),
                (none.cast(order_type) if k3 is None else k3.cast(order_type)).alias("k3")]

    def own(k2: int, line):
        return block.select("model", *at(1, k2, F.col("k1")), line.alias("line"))

    arrows = F.concat(F.col("src"), F.lit(" "), arrow, F.lit(" "), F.col("dst"),
                      F.when(F.col("rel_name") != "", F.concat(F.lit(" : "), F.col("rel_name"))).otherwise(F.lit("")))
    typed = F.when(F.col("attr_type").isNull(), F.col("attr_name")).otherwise(F.concat_ws(" : ", "attr_name", "attr_type"))
    lines = [
        head.select("model", *at(0, 0), F.lit("@startuml").alias("line")),
        head.select("model", *at(0, 1), F.lit(f"!theme {theme}").alias("line")),
        own(0, F.concat(F.lit("class "), F.col("class_name"))),
        own(1, F.lit("{")),
        attributes.join(block, ["model", "class_name"]).select(
            "model", *at(1, 2, F.col("k1"), F.col("first_ord")), typed.alias("line")),
        own(3, F.lit("}")),
        rels.join(block.withColumnRenamed("class_name", "src"), ["model", "src"]).select(
            "model", *at(1, 4, F.col("k1"), F.col("first_ord")), arrows.alias("line")),
        head.select("model", *at(2, 0), F.lit("@enduml").alias("line")),
    ]
    return reduce(DataFrame.unionByName, lines)


def write_plantuml(lines: DataFrame, path: str) -> None:
    """S7 sink: one text file set, rows ordered by (model, sort key); partitioned by model."""
    (lines.repartition("model").sortWithinPartitions("model", "k0", "k1", "k2", "k3", "line")
     .select("model", "line").write.mode("overwrite").partitionBy("model").text(path))


def read_plantuml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines written by S7 and S8 -> (classes, attributes, relations).

    Positions are line numbers: a file's lines in the order of its blocks, then as read within a block.  The
    enclosing class of an attribute is the last class line above it (a running last-non-null window per file).
    An attribute line ``name : `` has the empty type, one without `` : `` none.  A reference with labels at both ends is
    a relation each way.  Packages, enums, data types and super types give no rows.
    """
    # ``model`` comes from partition discovery of the S7 layout (names unescaped), as text: 007 is not 7
    scan = spark.read.schema("value string, model string").text(path)
    place = scan.metadataColumn("_metadata")
    raw = scan.select("model", "value", place.getField("file_path").alias("_path"),
                      place.getField("file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_read"))
    line = F.trim("value")
    order = W.partitionBy("_path").orderBy("_block", "_read")
    w = order.rowsBetween(W.unboundedPreceding, 0)
    head = r"^(?:class|interface)\s+(\S+?)(\s*\{)?$"
    cls = F.regexp_extract(line, head, 1)
    opens = (line == "{") | (cls != "") & line.endswith("{")
    t = raw.select("model", F.row_number().over(order).cast("long").alias("ln"), line.alias("line"),
                   F.regexp_replace("value", r"^\s+", "").alias("full"), cls.alias("cls"),
                   F.last(F.when(cls != "", cls), True).over(w).alias("owner"), opens.alias("opens"),
                   F.last(F.when(opens, F.lit(True)).when((line == "}") | line.rlike(r"^enum\s"), F.lit(False)), True).over(w)
                   .alias("inside"))
    classes = t.filter(F.col("cls") != "").select("model", F.col("ln").alias("class_pos"), F.col("cls").alias("class_name"))
    body = t.filter(F.col("inside") & ~F.col("opens"))
    attributes = body.select("model", F.col("owner").alias("class_name"), F.col("ln").alias("attr_pos"),
                             F.substring_index("full", " : ", 1).alias("attr_name"),
                             F.when(F.col("full").contains(" : "),
                                    F.regexp_extract("full", r"^.*? : (.*)$", 1)).alias("attr_type"))
    rel_re = r'^(\S+)\s+(?:"(\d)"\s+)?-->(?:\s+"([\d*])")?\s+(\S+)(?:\s:\s(.*))?$'
    ref_re = r'^(\S+) "([^"]*) ([^" ]+)" \*?--(?:>|\*? "([^"]*) ([^" ]+)") (\S+)$'
    outside = t.filter(~F.coalesce("inside", F.lit(False)))
    r = outside.filter(F.col("line").rlike(rel_re))
    lo, hi = F.regexp_extract("line", rel_re, 2), F.regexp_extract("line", rel_re, 3)
    relations = r.select("model", F.col("ln").alias("rel_pos"), F.regexp_extract("line", rel_re, 1).alias("src"),
                         F.regexp_extract("line", rel_re, 4).alias("dst"),
                         F.when(lo == "", "").otherwise(F.concat(lo, F.lit(".."), hi)).alias("mult"),
                         F.regexp_extract("line", rel_re, 5).alias("rel_name"))
    part = lambda i: F.regexp_extract("line", ref_re, i)
    ends = F.array(F.struct(part(1).alias("src"), part(6).alias("dst"), part(3).alias("mult"), part(2).alias("rel_name")),
                   F.struct(part(6).alias("src"), part(1).alias("dst"), part(5).alias("mult"), part(4).alias("rel_name")))
    refs = outside.filter(F.col("line").rlike(ref_re) & ~F.col("line").rlike(rel_re)).select(
        "model", F.col("ln").alias("rel_pos"), F.explode(F.when(part(5) == "", F.slice(ends, 1, 1)).otherwise(ends)).alias("x"))
    return classes, attributes, relations.unionByName(refs.select("model", "rel_pos", "x.*"))


def write_fragments(fc: DataFrame, fa: DataFrame, fr: DataFrame, path: str) -> None:
    """Fragment store, Parquet partitioned by model."""
    for name, df in (("classes", fc), ("attributes", fa), ("rels", fr)):
        df.write.mode("overwrite").partitionBy("model").parquet(f"{path}/{name}")


def read_fragments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables as written; ``model`` stays text, whatever it looks like."""
    def table(name):
        stored = spark.read.parquet(f"{path}/{name}").drop("model").schema
        return spark.read.schema(stored.add("model", "string")).parquet(f"{path}/{name}")
    return table("classes"), table("attributes"), table("rels")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Tables (pass / fail lists, scores, summaries) as Parquet (default), CSV or JSON."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def save_model(model, path: str) -> None:
    """Trained Spark ML pipeline save (load with ``PipelineModel.load``)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
