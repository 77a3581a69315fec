"""Operator 10, quality rules: hashed n-gram log-likelihood ratios.  DataFrame functions only.

Words and pairs of words fall into ``BUCKETS`` buckets by hash.  Two multinomials are counted: the
raw corpus (every document) and the trusted target (documents labelled as good).  The target is smoothed
with ``BUCKETS`` pseudo-counts spread like the raw corpus, so that a small target says little.  A
document's verdict is the mean log-likelihood ratio of its n-grams, kept at ``THRESHOLD`` or more, every
document by the same rule; the base rules (too few words, too many repeated ones) come first.

The trusted target is bounded: of the documents with quality 1, the ``trusted`` ids that come first
by hash (all where there are fewer).  Their ids are broadcast, and so is the table of ratios (one double
a bucket).  The raw counts take in every document.  Two passes over the texts, one small shuffle
(buckets, combined before it).

Defined cases: null text has no words; a text without words fails the base rules and has ratio 0;
null ids match no label; repeated rows and ids are rows like any other, and each counts; without trusted
documents every ratio is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, pick, store

BUCKETS = 1 << 14
TRUSTED = 20_000
THRESHOLD = -0.1
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _bucket(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def buckets(w: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours; ``w`` is a column, not an expression."""
    pairs = F.when(F.size(w) > 1, F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                                              lambda x, i: _bucket(F.get(w, i), x)))
    return F.concat(F.transform(w, lambda x: _bucket(x)), F.coalesce(pairs, F.array().cast("array<int>")))


def repeat_words(w: Column, span: int = 5) -> Column:
    """Words in windows of ``span`` words that occur twice or more; linear but for one sort where some do."""
    n = F.size(w)
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(span)])
    hashes = F.when(n >= span, F.transform(F.sequence(F.lit(0), n - span), window))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"])
                                              | (x["h"] == F.get(s, k + 1)["h"])))
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(-span).alias("last"), F.lit(0).alias("total")),
                           lambda a, i: F.struct(i.alias("last"),
                                                 (a["total"] + F.least(F.lit(span), i - a["last"])).alias("total")),
                           lambda a: a["total"])

    # null where the text is too short or every window differs
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)))
    return F.coalesce(some, F.lit(0)).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """(.., text, words) -> adds the base counts and ``base_failed``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return (docs.withColumn("n_words", F.size("words").cast("long"))
            .withColumn("word_chars", F.length(F.translate(text, SPACE, "")).cast("long"))
            .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("n_repeat_words", repeat_words(F.col("words")))
            .withColumn("base_failed", (F.col("n_words") < 10)
                        | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))


def trusted_ids(labels: DataFrame, trusted: int = TRUSTED) -> DataFrame:
    """At most ``trusted`` distinct ids of quality 1; ``labels`` (doc_id, quality)."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(trusted)


def ratios(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: ``ratio``, the log-likelihood ratio of each bucket; ``docs`` (doc_id, words), ``ids`` bounded."""
    marked = docs.join(F.broadcast(ids.withColumn("good", F.lit(1))), "doc_id", "left")
    counts = (marked.select("good", F.explode(buckets(F.col("words"))).alias("b")).groupBy("b")
              .agg(F.count(F.lit(1)).alias("r"), F.count("good").alias("t")))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    counts = store(every.join(counts, "b", "left").na.fill(0, ["r", "t"]))
    whole = counts.agg(F.sum("r").alias("raw"), F.sum("t").alias("good"))
    p = (F.col("r") + 1) / (F.col("raw") + BUCKETS)
    ratio = F.log((F.col("t") + BUCKETS * p) / (F.col("good") + BUCKETS) / p)
    # BUCKETS rows and one row: both bounded by the parameter
    table = counts.join(F.broadcast(whole), F.lit(True)).select("b", ratio.alias("v"))
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]).alias("ratio"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            quality_col: str = "quality", trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``ratio`` (mean) and ``kept``, one row per row of ``docs``."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("words", words(F.col("text")))
    ids = store(trusted_ids(pick(labels, doc_id=id_col, quality=quality_col), trusted))
    table = store(ratios(d.select("doc_id", "words"), ids))
    scored = (base(d).withColumn("buckets", buckets(F.col("words")))
              .withColumn("table", table.scalar()))
    total = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get(F.col("table"), b))
    mean = F.when(F.col("n_words") > 0, total / F.size("buckets")).otherwise(F.lit(0.0))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", mean.alias("ratio")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
