"""Shallow annotator.  Text -> sentences -> annotated token table -> chunk names.

The texts are dealt out by ``doc_id`` before they are split, so the one exchange moves
texts and not tokens; sentences and words are DataFrame expressions, and batches of
sentences are annotated as columns of numbers (see the kernel), each step one pass over
all tokens of the batch: a junk sentence of thousands of tokens costs time in proportion
to its length.  Names are DataFrame expressions, and reuse the partitioning of stored tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import lexicon_df
from ..functions.text import SENTENCE_SPLIT, TOKEN_PATTERN, capitalize, is_upper
from .kernel import tokens_of

KEY = ["doc_id", "sent_id"]

INT, TEXT, FLAG = T.IntegerType(), T.StringType(), T.BooleanType()
TOKEN_FIELDS = [T.StructField(c, t) for c, t in (
    ("tok_id", INT), ("text", TEXT), ("lemma", TEXT), ("pos", TEXT), ("dep", TEXT), ("head", INT), ("is_stop", FLAG),
    ("chunk_root", INT), ("n_chunks", INT), ("multi_sent", FLAG))]
TOKEN_COLUMNS = [*KEY, *[f.name for f in TOKEN_FIELDS]]


def sentences(corpus: DataFrame) -> DataFrame:
    """T1 step 1: ``(doc_id, text)`` -> ``(doc_id, sent_id, sentence)``; split, trim, drop blanks."""
    return (corpus.select("doc_id", F.posexplode(F.split("text", SENTENCE_SPLIT)).alias("sent_id", "sentence"))
            .select("doc_id", F.col("sent_id").cast("int").alias("sent_id"), F.trim("sentence").alias("sentence"))
            .filter(F.col("sentence") != ""))


def sentence_words(sents: DataFrame) -> DataFrame:
    """T1 step 2: the tokens of each sentence in order, (doc_id, sent_id, words), the rows sorted by sentence in their partitions."""
    return sents.select(*KEY, "sentence").sortWithinPartitions(*KEY).select(
        *KEY, F.regexp_extract_all("sentence", F.lit(TOKEN_PATTERN), 0).alias("words"))


def lexicon_entries(lexicon: DataFrame) -> list[tuple]:
    """T1 step 3: the closed-class lexicon, which every task holds."""
    return [tuple(r) for r in lexicon.select("word", "lex_pos", "lex_lemma", "lex_stop").collect()]


def by_document(corpus: DataFrame, pieces: int | None = None) -> DataFrame:
    """Texts dealt out by ``doc_id`` to ``pieces`` partitions, the session's shuffle partitions by default: what is made of
    a text then stays in its partition."""
    return corpus.repartition(pieces or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def annotate(corpus: DataFrame, lexicon: DataFrame | None = None, pieces: int | None = None) -> DataFrame:
    """T1 + T2 + T8: the annotated ``tokens`` table of SURVEY 1.3.

    ``corpus`` has ``doc_id`` and ``text``.  Columns out: ``TOKEN_COLUMNS``, dealt out by ``doc_id``.
    """
    spark = corpus.sparkSession
    if lexicon is None:
        lexicon = lexicon_df(spark)
    return annotate_sentences(sentences(by_document(corpus.select("doc_id", "text"), pieces)), lexicon)


def annotate_sentences(sents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The token table of (doc_id, sent_id, sentence) rows that are dealt out by ``doc_id``.

    A batch of sentences is annotated as columns of numbers (see the kernel), which takes a fraction of the time that windows
    over rows do; sentences of one key, if there are several, are one."""
    words = sentence_words(sents)
    schema = T.StructType([*words.select(*KEY).schema.fields, *TOKEN_FIELDS])
    return words.mapInArrow(tokens_of(lexicon_entries(lexicon)), schema)


def packed(tokens: DataFrame) -> DataFrame:
    """The token table as it is stored: a lemma only where it is not the text in lower case, other tokens by their distance."""
    away = {c: F.col(c) - F.col("tok_id") for c in ("head", "chunk_root")}
    return tokens.withColumns({"lemma": F.when(F.col("lemma") != F.lower("text"), F.col("lemma")), **away})


def unpacked(stored: DataFrame) -> DataFrame:
    """The token table again, from what :func:`packed` made of it; lemmas are never null."""
    there = {c: F.col(c) + F.col("tok_id") for c in ("head", "chunk_root")}
    return stored.withColumns({"lemma": F.coalesce("lemma", F.lower("text")), **there})


def chunk_names(tokens: DataFrame) -> DataFrame:
    """T3 / T4 / T5 once per chunk: ``(doc_id, sent_id, chunk_root, pascal, camel, explicit)``.

    Grouping keys extend ``(doc_id, sent_id)``, so the token partitioning is reused.
    """
    tid, cr, text, lemma, stop = F.col("tok_id"), F.col("chunk_root"), F.col("text"), F.col("lemma"), F.col("is_stop")
    up = is_upper(text)
    kept3 = ~stop & (text != "exactly")
    kept4 = ~stop
    kept5 = ~stop & (tid != cr)
    c = tokens.filter(cr.isNotNull()).select(
        *KEY, "chunk_root", "tok_id",
        F.when(kept3, F.when(up, text).when(tid == cr, capitalize(lemma)).otherwise(capitalize(text))).alias("p3"),
        F.when(kept4, F.when(up, text).otherwise(lemma)).alias("p4"),
        F.when(kept5, F.when(up, text).otherwise(capitalize(lemma))).alias("p5"),
        F.when(tid == cr, text).alias("root_text"), F.when(tid == cr, lemma).alias("root_lemma"))
    g = c.groupBy(*KEY, "chunk_root").agg(
        F.expr("listagg(p3, '') WITHIN GROUP (ORDER BY tok_id)").alias("pascal_raw"),
        F.expr("listagg(p5, '') WITHIN GROUP (ORDER BY tok_id)").alias("explicit_raw"),
        F.expr("listagg(" + "concat(upper(substring(p4, 1, 1)), lower(substring(p4, 2)))"
               + ", '') WITHIN GROUP (ORDER BY tok_id)").alias("cap4"),
        F.min_by("p4", F.when(F.col("p4").isNotNull(), tid)).alias("first4"),
        F.max("root_text").alias("root_text"), F.max("root_lemma").alias("root_lemma"))
    empty = lambda x: F.col(x).isNull() | (F.col(x) == "")
    root_up = is_upper(F.col("root_text"))
    return g.select(
        *KEY, "chunk_root",
        F.when(empty("pascal_raw"), F.when(root_up, F.col("root_text")).otherwise(capitalize(F.col("root_lemma"))))
        .otherwise(F.col("pascal_raw")).alias("pascal"),
        F.when(empty("cap4"), F.when(root_up, F.col("root_text")).otherwise(F.col("root_lemma")))
        .otherwise(F.concat(F.col("first4"), F.expr("substring(cap4, length(first4) + 1)"))).alias("camel"),
        F.when(~empty("explicit_raw"), F.col("explicit_raw")).alias("explicit"))


def token_names(tokens: DataFrame, names: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Per-token name view for rule actions: chunk names where the token is a chunk root,
    else the fall-back of the name functions (upper text, or capitalised lemma / lemma).

    ``asked`` (doc_id, sent_id, tok_id): the tokens to name, all by default; only their chunks are then put together.
    """
    own = tokens.select(*KEY, "tok_id", "text", "lemma")
    if asked is not None:
        asked = asked.select(*KEY, "tok_id").distinct()
        own = own.join(asked, [*KEY, "tok_id"], "left_semi")
        if names is None:
            tokens = tokens.join(asked.withColumnRenamed("tok_id", "chunk_root"), [*KEY, "chunk_root"], "left_semi")
    if names is None:
        names = chunk_names(tokens)
    up = is_upper(F.col("text"))
    j = own.join(names.withColumnRenamed("chunk_root", "tok_id"), [*KEY, "tok_id"], "left")
    word = F.col("text").rlike("^[A-Za-z0-9]+$")
    return j.select(
        *KEY, "tok_id", "lemma",
        F.coalesce("pascal", F.when(~word, F.col("text")).when(up, F.col("text"))
                   .otherwise(capitalize(F.col("lemma")))).alias("pascal"),
        F.coalesce("camel", F.when(~word, F.col("text")).when(up, F.col("text"))
                   .otherwise(F.col("lemma"))).alias("camel"),
        "explicit")
