"""Corpus preparation as joins, ordered string aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import conjunctive_join, ensure_period

KEY = ["doc_id", "sent_id"]


def label_kind_pairs(labels: DataFrame, fragments: DataFrame, label_key: str, fragment_key: str,
                     text: str, kind: str) -> DataFrame:
    """Each label joined to its fragment's kind -> (id, english, kind).

    Equi-join form; the original's positional lookup equals it when fragment ids
    have no gaps (a positional rank would need one global ordering).
    """
    f = fragments.select(F.col(fragment_key).alias("_fk"), F.col(kind).cast("string").alias("kind"))
    return labels.join(f, labels[label_key] == f["_fk"]).select(
        F.col(label_key).alias("id"), F.col(text).alias("english"), "kind")


def group_texts(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Per group, texts in order, each ending with ``.``, joined with one space."""
    r = rows.select(group, order, ensure_period(F.col(text)).alias("_t"))
    return r.groupBy(group).agg(F.expr(f"listagg(_t, ' ') WITHIN GROUP (ORDER BY {order})").alias("text"))


def conjunctive_list(rows: DataFrame, group: str, order: str, word: str) -> DataFrame:
    """P5 over an ordered word list per group: ``a,b and c``."""
    lst = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w")))),
                      lambda s: s["w"])
    return rows.groupBy(group).agg(conjunctive_join(lst).alias("joined"))


def rebuild_sentences(tokens: DataFrame) -> DataFrame:
    """Token texts joined with a space per sentence, stripped."""
    return tokens.groupBy(*KEY).agg(
        F.trim(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY tok_id)")).alias("sentence"))


def split_dataset(corpus: DataFrame, sents: DataFrame, doc_kind: DataFrame, sentence_kind: DataFrame
                  ) -> DataFrame:
    """A one-sentence text keeps its text and kind with a null offset; a longer
    one gives a row per sentence with the sentence's predicted kind, offset = sentence id."""
    n = sents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    single = (corpus.join(n.filter("_n = 1"), "doc_id").join(doc_kind, "doc_id")
              .select("doc_id", F.col("text").alias("english"), "kind", F.lit(None).cast("int").alias("offset")))
    multi = (sents.join(n.filter("_n > 1"), "doc_id").join(sentence_kind, KEY)
             .select("doc_id", F.col("sentence").alias("english"), "kind", F.col("sent_id").alias("offset")))
    return single.unionByName(multi)


def exclude_models(df: DataFrame, excluded: DataFrame, model: str = "model") -> DataFrame:
    """Drop rows of listed models (anti join; Spark broadcasts a list whose size allows it)."""
    return df.join(excluded.select(F.col(excluded.columns[0]).alias(model)), model, "left_anti")


def fragment_names(model_classes: DataFrame, model_rels: DataFrame) -> DataFrame:
    """Number class and relation fragments per model, named ``{model}_{kind}{n}``."""
    from ..functions.order import placed

    c = model_classes.select(F.struct("model", F.lit("class").alias("kind")).alias("g"), F.col("first_ord").alias("o"),
                             F.col("class_name").alias("item"))
    r = model_rels.select(F.struct("model", F.lit("rel").alias("kind")).alias("g"), F.col("first_ord").alias("o"),
                          F.concat_ws(" ", "src", "dst", "rel_name").alias("item"))
    u = placed(c.unionByName(r), "g", ["o", "item"], "n")
    return u.select("g.model", "g.kind", "item", F.format_string("%s_%s%d", F.col("g.model"), F.col("g.kind"),
                                                                 F.col("n") + 1).alias("fragment"))


def fragment_lookup(labels: DataFrame, fragments: DataFrame, label_fk: str, fragment_key: str) -> DataFrame:
    """Label id -> fragment row -> ``{model}_{kind}{number}``."""
    f = fragments.select(F.col(fragment_key).alias("_fk"),
                         F.format_string("%s_%s%d", F.col("model"), F.col("kind"), F.col("number"))
                         .alias("fragment"))
    return labels.join(f, labels[label_fk] == f["_fk"]).drop("_fk")


def models_of(df: DataFrame, model: str | None = None, column: str = "model") -> DataFrame:
    """P10: fragments grouped by model, with an optional one-model selection."""
    return df if model is None else df.filter(F.col(column) == model)


def nearest_antecedents(tokens: DataFrame, pronouns=("it", "them")) -> DataFrame:
    """For each pronoun token (exact, case-sensitive text), the nearest preceding
    noun-chunk root of the same document -> (doc_id, sent_id, tok_id, text, antecedent)."""
    w = (W.partitionBy("doc_id").orderBy("sent_id", "tok_id")
         .rowsBetween(W.unboundedPreceding, -1))
    is_root = F.col("pos").isin("NOUN", "PROPN") & (F.col("tok_id") == F.col("chunk_root"))
    # the other tokens are neither, so the window need not sort them
    t = tokens.select(*KEY, "tok_id", "text", "pos", "chunk_root").filter(is_root | F.col("text").isin(*pronouns)).withColumn(
        "antecedent", F.last(F.when(is_root, F.col("text")), True).over(w))
    return t.filter(F.col("text").isin(*pronouns)).select(*KEY, "tok_id", "text", "antecedent")


def substitute_pronouns(tokens: DataFrame, mentions: DataFrame, pronouns=("it", "them"),
                        case_insensitive: bool = False) -> DataFrame:
    """Replace each pronoun mention (root text exactly ``it`` / ``them``) by the words of
    its chain's most specific mention (``a,b and c``, P5); returns tokens with a ``resolved`` column (the
    replacement once on the mention's first token, empty on its other tokens).

    ``mentions``: (doc_id, chain_id, mention_id, sent_id, root_index, token_indexes ARRAY<INT>,
    is_most_specific).
    """
    toks = tokens.select(*KEY, "tok_id", "text")
    # text of the most specific mentions: P5 over their words (a mention is a few words)
    words = F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])
    best = (mentions.filter("is_most_specific")
            .select("doc_id", "chain_id", "sent_id", F.posexplode("token_indexes").alias("k", "tok_id"))
            .join(toks, [*KEY, "tok_id"]).groupBy("doc_id", "chain_id")
            .agg(conjunctive_join(words).alias("replacement")))
    root = toks.select(*KEY, F.col("tok_id").alias("root_index"), F.col("text").alias("root_text"))
    prn = mentions.join(root, [*KEY, "root_index"])
    cond = (F.lower("root_text").isin(*pronouns) if case_insensitive else F.col("root_text").isin(*pronouns))
    prn = prn.filter(cond & ~F.col("is_most_specific")).join(best, ["doc_id", "chain_id"])
    first = F.array_min("token_indexes")
    rep = prn.select(*KEY, F.explode("token_indexes").alias("tok_id"), first.alias("_first"), "replacement")
    rep = rep.select(*KEY, "tok_id", F.when(F.col("tok_id") == F.col("_first"), F.col("replacement"))
                     .otherwise(F.lit("")).alias("_rep"))
    return toks.join(rep, [*KEY, "tok_id"], "left").select(
        *KEY, "tok_id", "text", F.coalesce("_rep", "text").alias("resolved"))


def antecedent_mentions(tokens: DataFrame, pronouns=("it", "them")) -> DataFrame:
    """The mentions of P4 by P4a's heuristic: a chain is a noun-chunk root with the pronouns that it is the nearest
    antecedent of.  Pronouns without a noun before them are in no chain."""
    w = W.partitionBy("doc_id").orderBy("sent_id", "tok_id").rowsBetween(W.unboundedPreceding, -1)
    is_root = F.col("pos").isin("NOUN", "PROPN") & (F.col("tok_id") == F.col("chunk_root"))
    place = F.struct("sent_id", "tok_id")
    said = (tokens.select(*KEY, "tok_id", "text", "pos", "chunk_root").filter(is_root | F.col("text").isin(*pronouns))
            .withColumn("chain_id", F.last(F.when(is_root, place), True).over(w))
            .filter(F.col("text").isin(*pronouns) & F.col("chain_id").isNotNull())
            .select("doc_id", "chain_id", place.alias("mention_id"), F.lit(False).alias("is_most_specific")))
    named = said.select("doc_id", "chain_id", F.col("chain_id").alias("mention_id"),
                        F.lit(True).alias("is_most_specific")).distinct()
    return said.unionByName(named).select(
        "doc_id", "chain_id", "mention_id", "mention_id.sent_id", F.col("mention_id.tok_id").alias("root_index"),
        F.array("mention_id.tok_id").alias("token_indexes"), "is_most_specific")


def resolved_sentences(tokens: DataFrame, mentions: DataFrame, pronouns=("it", "them")) -> DataFrame:
    """The sentences with their pronouns replaced -> (doc_id, sent_id, sentence)."""
    r = substitute_pronouns(tokens, mentions, pronouns)
    return rebuild_sentences(r.filter("resolved <> ''").select(*KEY, "tok_id", F.col("resolved").alias("text")))
