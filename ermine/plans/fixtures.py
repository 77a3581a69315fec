"""Plans over the given tables: the document pipeline and the assembly fixture.

Everything reads whole tables from ``sf_dir`` (or data Spark derives from them).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import lexicon_df
from ..functions.text import capitalize, lower_first
from ..operators import annotate as A
from ..operators import assemble as M
from ..operators import classify as C
from ..operators import extract as X
from ..operators.rules import RULES, Rule, rule_hits, sentence_roles
from ..session import checkpoint_dir, cut_lineage, cut_lineage_by, text_pieces
from ..sources.ecore import ecore_text
from ..sources.models import write_plantuml

# Stage outputs read by several queries are written once, as Parquet, into ``spark.checkpoint.dir``:
# the plan downstream starts from a flat scan (the annotation and 17 rule plans are not
# re-analysed per action) that prunes columns and takes filters, and lost executors recompute nothing.
_CACHE: dict = {}
TOKEN_BYTES = 2 << 20  # text of a task: its sorted tokens are some 200 MB, its share of a small executor's memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def doc_pieces(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that the texts are dealt out to by ``doc_id``."""
    key = ("pieces", id(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = text_pieces(corpus(spark, sf_dir), size=TOKEN_BYTES)
    return _CACHE[key]


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated tokens of all documents (test lexicon), stored once per session and folder, in buckets of ``doc_id``."""
    key = ("tokens", id(spark), sf_dir)
    if key not in _CACHE:
        n = doc_pieces(spark, sf_dir)
        tokens = A.packed(A.annotate(corpus(spark, sf_dir), lexicon_df(spark, True), n))
        _CACHE[key] = A.unpacked(cut_lineage_by(tokens, "doc_id", n))
    return _CACHE[key]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled texts with their kind: (doc_id, text, label)."""
    kind = F.when(F.col("quality") == 1, "class").otherwise("rel")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(
        table(spark, sf_dir, "labels").select("doc_id", kind.alias("label")), "doc_id")


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences, stored once in buckets of ``doc_id``: rules, training terms, terms to score and the list of
    sentences all start from them."""
    key = ("sentences", id(spark), sf_dir)
    if key not in _CACHE:
        n = doc_pieces(spark, sf_dir)
        s = A.sentences(A.by_document(corpus(spark, sf_dir).select("doc_id", "text"), n))
        _CACHE[key] = cut_lineage_by(s, "doc_id", n)
    return _CACHE[key]


def doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rule results; stored, because kinds, selection, coverage and assembly all read them.

    Tokens are made on the way and not stored: the rules go through them once."""
    key = ("hits", id(spark), sf_dir)
    if key not in _CACHE:
        n = doc_pieces(spark, sf_dir)
        kept = sentence_roles(doc_sentences(spark, sf_dir), lexicon_df(spark, True), RULES)
        _CACHE[key] = cut_lineage_by(X.all_hits(None, pieces=n, kept=kept), "doc_id", n)
    return _CACHE[key]


def doc_rule_hits(spark: SparkSession, sf_dir: str, rule: Rule) -> DataFrame:
    """The results of one rule, from the texts: of the tokens only those with a role are stored."""
    n = doc_pieces(spark, sf_dir)
    sents = A.sentences(A.by_document(corpus(spark, sf_dir).select("doc_id", "text"), n))
    return rule_hits(None, rule, pieces=n, kept=sentence_roles(sents, lexicon_df(spark, True), [rule]))


def sentence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every sentence, by the Bernoulli model (C4) of the sentences whose rule results are of one kind."""
    key = ("kinds", id(spark), sf_dir)
    if key not in _CACHE:
        sent = ["doc_id", "sent_id"]
        n = doc_pieces(spark, sf_dir)
        one = doc_hits(spark, sf_dir).groupBy(*sent).agg(F.min("kind").alias("label"), F.max("kind").alias("other"))
        known = cut_lineage_by(one.filter("label = other").select(*sent, "label"), "doc_id", n)
        s = doc_sentences(spark, sf_dir)
        terms = C.term_counts(s, sent, "sentence")
        scores = C.bernoulli_nb(terms.join(known.hint("shuffle_hash"), sent), terms, train_docs=known, test_docs=s, key=sent, pieces=n)
        best = C.predict(scores.withColumn("score", F.round("score", 6)), sent)
        _CACHE[key] = cut_lineage_by(best.select(*sent, F.col("prediction").alias("kind")), "doc_id", n)
    return _CACHE[key]


def doc_best(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    key = ("best", id(spark), sf_dir, compat)
    if key not in _CACHE:
        best = X.select_best(X.dispatch(doc_hits(spark, sf_dir), sentence_kinds(spark, sf_dir)), compat)
        _CACHE[key] = cut_lineage_by(best, "doc_id", doc_pieces(spark, sf_dir))
    return _CACHE[key]


def doc_fragments(spark: SparkSession, sf_dir: str, compat: bool = False):
    models = corpus(spark, sf_dir).select("doc_id", F.col("source").alias("model"))
    return X.fragments(doc_best(spark, sf_dir, compat), models)


def doc_model(spark: SparkSession, sf_dir: str):
    return M.assemble(*doc_fragments(spark, sf_dir))


# ---- assembly fixture from part and lineitem ---------------------------------

def pascal(c) -> F.Column:
    return F.array_join(F.transform(F.split(c, " "), capitalize), "")


def part_fragments(spark: SparkSession, sf_dir: str):
    """Class fragments (one per part) and relation fragments (consecutive lines of an order)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    p = part.withColumn("pname", pascal(F.col("p_name")))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("pname").alias("next_pname"))
    p = p.join(nxt, "p_partkey", "left")
    cls_name = F.when(F.col("p_partkey") % 17 == 0, F.upper("pname")).otherwise(F.col("pname"))
    attr_name = F.when((F.col("p_partkey") % 29 == 0) & F.col("next_pname").isNotNull(),
                       lower_first(F.col("next_pname"))).otherwise(F.lower("p_type"))
    seq = F.struct(F.col("p_partkey").alias("major"), F.lit(0).alias("minor"))
    p = p.select(F.col("p_brand").alias("model"), seq.alias("seq"), cls_name.alias("class_name"),
                 attr_name.alias("attr_name"),
                 F.when(F.col("p_size") % 2 == 1, F.lit("string")).alias("attr_type"))
    fc = M.fragment_class_rows(p, "model", "seq", "class_name")
    fa = M.fragment_attribute_rows(p, "model", "seq", "class_name", "attr_name", "attr_type")

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_extendedprice", "l_returnflag")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = (li.withColumn("rn", F.row_number().over(w)).withColumn("next_part", F.lead("l_partkey").over(w))
          .filter(F.col("next_part").isNotNull()))
    names = part.select("p_partkey", "p_brand", pascal(F.col("p_name")).alias("pname"))
    a = names.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"),
                     F.col("pname").alias("src"))
    b = names.select(F.col("p_partkey").alias("next_part"), F.col("pname").alias("dst"))
    r = li.join(a, "l_partkey").join(b, "next_part").select(
        "model", F.struct(F.col("l_orderkey").alias("major"), F.col("rn").alias("minor")).alias("seq"), "src", "dst",
        F.when(F.col("rn") % 3 == 0, "").when(F.col("rn") % 3 == 1, "0..*").otherwise("1..1").alias("mult"),
        F.lower("l_returnflag").alias("rel_name"))
    fr = M.fragment_rel_rows(r, "model", "seq", "src", "dst", "mult", "rel_name")
    return fc, fa, fr


def assembled(fc: DataFrame, fa: DataFrame, fr: DataFrame):
    """A1 over fragments whose merged classes and relations are stored, as each model table is made of them once more."""
    canon = cut_lineage(M.canonical_classes(fc))
    return M.consolidate(canon, M.owned(M.partial_attributes(fa), canon), cut_lineage(M.merged_relations(fr)))


def part_model(spark: SparkSession, sf_dir: str):
    key = ("part model", id(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = assembled(*part_fragments(spark, sf_dir))
    return _CACHE[key]


def ecore_files(spark: SparkSession, sf_dir: str) -> str:
    """The part models as Ecore files, one a brand, in the shared folder."""
    key = ("ecore", id(spark), sf_dir)
    if key not in _CACHE:
        path = f"{checkpoint_dir(spark)}/ecore-{uuid.uuid4().hex}"
        # stored first: the lines of a file come from each table several times
        write_plantuml(ecore_text(*(cut_lineage(x) for x in part_model(spark, sf_dir))), path)
        _CACHE[key] = path
    return _CACHE[key]


# ---- truth and prediction: the same fragments, all of them, and an altered copy ------------------

MOVED, ADDED = "Brand#7", "Brand#0"   # a model only the truth has, and one only the prediction has
KEPT = "Brand#5"                      # a model that both sides have alike


def sided_fragments(spark: SparkSession, sf_dir: str):
    """Fragments whose ``model`` is (side, model).  The prediction renames classes, retypes attributes, changes
    multiplicities and directions, adds classes and moves one model to another name; it loses no row."""
    def sided(df, side, model=F.col("model")):
        return df.withColumn("model", F.struct(F.lit(side).alias("side"), model.alias("model")))

    fc, fa, fr = (cut_lineage(x) for x in part_fragments(spark, sf_dir))
    # a number that no remainder asked for below fits, where the model is left alone
    major = F.when(F.col("model") == KEPT, 1).otherwise(F.col("seq.major"))
    minor = F.when(F.col("model") == KEPT, 0).otherwise(F.col("seq.minor"))
    model = F.when(F.col("model") == MOVED, ADDED).otherwise(F.col("model"))
    name = F.when(major % 5 == 0, F.concat(F.col("class_name"), F.lit("Item"))).otherwise(F.col("class_name"))
    pc = fc.withColumn("class_name", name)
    extra = fc.filter(major % 11 == 0).withColumn("class_name", F.concat(F.lit("New"), F.col("class_name")))
    pa = fa.withColumn("class_name", name).withColumn("attr_type", F.when(major % 3 == 0, "int").otherwise(F.col("attr_type")))
    turned = (major + minor) % 13 == 0
    pr = fr.select("model", "seq", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"),
                   F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"),
                   F.when(major % 7 == 0, "1..*").otherwise(F.col("mult")).alias("mult"), "rel_name")
    return tuple(sided(t, "truth").unionByName(sided(p, "prediction", model))
                 for t, p in ((fc, pc.unionByName(extra)), (fa, pa), (fr, pr)))


def sided_models(spark: SparkSession, sf_dir: str, asked: tuple[int, ...] = (0, 1, 2)) -> dict[str, list[DataFrame]]:
    """The tables ``asked`` (classes, attributes, relations) of both sides from one assembly, each stored once."""
    key = ("sided", id(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = assembled(*sided_fragments(spark, sf_dir))
    for k in asked:
        if (*key, k) not in _CACHE:
            _CACHE[(*key, k)] = cut_lineage(_CACHE[key][k])
    return {side: [_CACHE[(*key, k)].filter(F.col("model.side") == side).withColumn("model", F.col("model.model")) for k in asked]
            for side in ("truth", "prediction")}
