"""Operator 3, mixing sources to target weights by Sainte-Lague apportionment.  DataFrame functions only.

A mix of as many words as the input is cut into equal blocks of ``BLOCK`` words.  Sources,
in code point order with null last, weigh ``WEIGHTS``, repeating.  A target stops at
``CAP`` times its source's size and the excess is shared again by weight (water-filling,
solved in one ordered pass).  Blocks go to sources by the highest quotients
``target / (2k + 1)``, and each source's blocks go to its shards the same way, so every
shard has an integer quota.  In a shard the documents stand in an order drawn from the seed;
the quota is that many blocks of the line, which starts again at its end (a repeat, ``CAP``
times at most).

Apportionment needs no loop: by rounding, the seats of a party lie between two shares that
differ by at most ``parties / blocks`` of it, so only quotients in between are ranked, about
two a party.

Scale: a source has one shard per ``SHARD_ROWS`` rows, so a hot source spreads over many
windows of bounded size; only the source table (one row a source) and a source's shard table
(one row a shard) are ordered as a whole.

Defined cases: null text has size 0; rows of size 0 take 0; null is a source of its own; repeated
rows and ids are rows like any other; an empty table gives an empty result; other columns are not
read (``mixed`` hands them on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pick, placed, store

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 8
SHARD_ROWS = 512
SEED = 42


def n_words(c) -> F.Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, order: list) -> DataFrame:
    """Adds ``quota``: the group's ``seats`` dealt by the highest quotients weight / (2k + 1), ties by ``order``."""
    own = Window.partitionBy(*(group or [F.lit(0)]))
    total, n = F.sum(weight).over(own), F.count(F.when(F.col(weight) > 0, 1)).over(own)
    p = (parties.withColumn("__h", F.col(seats).cast("double"))
         .withColumn("__x", F.when(total > 0, F.col(weight) * F.col("__h") / total).otherwise(F.lit(0.0)))
         .withColumn("__e", F.when(F.col("__h") > 0, n / (2 * F.col("__h"))).otherwise(F.lit(0.0)))
         .withColumn("__lo", F.greatest(F.lit(0), F.floor(F.col("__x") * (1 - F.col("__e")) + 0.5) - 1))
         .withColumn("__hi", F.when(F.col("__x") > 0, F.ceil(F.col("__x") * (1 + F.col("__e")) + 0.5) + 1)
                     .otherwise(F.lit(0)))
         .withColumn("__id", F.monotonically_increasing_id()))
    p = p.withColumn("__sure", F.sum("__lo").over(own))
    k = F.explode_outer(F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo"), F.col("__hi") - 1)))
    q = p.withColumn("__k", k).withColumn("__q", F.col(weight) / (2 * F.col("__k") + 1))
    rank = F.row_number().over(own.orderBy(F.desc_nulls_last("__q"), *order, "__k"))
    won = (F.col("__k").isNotNull() & (rank <= F.col(seats) - F.col("__sure"))).cast("long")
    q = q.withColumn("__won", won)
    keep = parties.columns
    return (q.groupBy(*keep).agg((F.first("__lo") + F.sum("__won")).cast("long").alias("quota")))


def targets(by_source: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, ..) -> adds ``place`` (1, 2, ..), ``target`` and ``total``."""
    one = Window.partitionBy(F.lit(0))
    place = F.row_number().over(one.orderBy(F.asc_nulls_last("source")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (by_source.withColumn("place", place).withColumn("w", w.cast("long"))
         .withColumn("cap", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(one)))
    line = one.orderBy(F.col("cap") / F.col("w"), "place")
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / rest)
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(one)
    s = s.withColumn("level", level)
    return (s.withColumn("target", F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("cap")),
                                          F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")))
            .drop("w", "cap", "level"))


def plan(rows: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_rows: int = SHARD_ROWS,
         seed: int = SEED, tie: tuple = ()) -> DataFrame:
    """(key, source, size) -> adds ``source_size``, ``target`` and ``taken``; ``rows`` should be a stored table.
    ``tie``: columns that order rows of equal key and size."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    s = (targets(by_source, weights, cap)
         .withColumn("n_shards", F.ceil(F.col("n_rows") / shard_rows).cast("long"))
         .withColumn("blocks", F.when(F.col("total") > 0, F.greatest(F.lit(1), F.floor(
             (F.col("total") + block / 2) / block))).otherwise(F.lit(0)).cast("long")))
    s = apportion(s, [], "target", "blocks", ["place"])
    s = store(s.select("source", "source_size", "target", "place", "n_shards", F.col("quota").alias("source_quota")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"))
    r = (rows.join(s, rows["source"].eqNullSafe(s["source"])).drop(s["source"])
         .withColumn("draw", draw)
         .withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("n_shards"))))
    shards = (r.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("seats")))
    quotas = store(apportion(shards, ["place"], "shard_size", "seats", ["shard"])
                   .select("place", "shard", "shard_size", "quota"))
    line = Window.partitionBy("place", "shard").orderBy("draw", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(quotas, ["place", "shard"])
    words = F.least(F.col("quota") * block, F.col("shard_size") * cap)
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    r = r.withColumn("words", words).withColumn("rounds", rounds)
    rest = F.col("words") - F.col("rounds") * F.col("shard_size") - F.col("start")
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return r.withColumn("taken", taken.cast("long")).select(*rows.columns, "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **params) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    d = pick(docs, key=id_col, source=source_col, text=text_col)
    sized = store(d.select("key", "source", n_words(F.col("text")).alias("size")))
    return plan(sized, **params).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          scan: bool = False, **params) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per repeat of a document; a part taken is its first words.

    The order is drawn from id and text, so it does not depend on the files' layout unless whole rows repeat.
    ``scan``: ``docs`` is a plain scan of stored files (see :func:`placed`); else it is stored first.
    """
    docs_at = placed(docs, scan)
    text = F.col(f"doc.`{text_col}`")
    key = F.concat_ws(":", F.col(f"doc.`{id_col}`").cast("string"), F.xxhash64(text).cast("string"))
    sized = store(docs_at.select(key.alias("key"), F.col(f"doc.`{source_col}`").alias("source"),
                                 n_words(text).alias("size"), "file", "at"))
    taken = plan(sized, tie=("file", "at"), **params).where("taken > 0").select("file", "at", "size", "taken")
    whole = (F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    # one plan at every size: a merge join, whatever the size of the taken rows
    rows = (docs_at.join(taken.hint("merge"), ["file", "at"]).withColumn("whole", whole).withColumn("part", part)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("whole") + (F.col("part") > 0).cast("int")))))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1,
                                F.col("part")), "")
    cut = F.when(F.col("copy") <= F.col("whole"), text).otherwise(head)
    return rows.select(*[cut.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def oracle(weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> str:
    """DuckDB SQL of :func:`mix` over ``documents``.  Seats come from a search for the divisor's threshold, not from
    the quotient window: all quotients that can win are listed and ranked."""
    n_w = len(weights)
    ws = "[" + ", ".join(map(str, weights)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM by_source),
s0 AS (SELECT *, {ws}[CAST((place - 1) % {n_w} + 1 AS INTEGER)] AS w, source_size * {cap} AS cap,
              CAST(sum(source_size) OVER () AS BIGINT) AS total FROM placed),
s1 AS (SELECT *, (total - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND
                  1 PRECEDING) AS BIGINT), 0)) / CAST(sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND
                  UNBOUNDED FOLLOWING) AS BIGINT) AS lv FROM s0),
s2 AS (SELECT *, max(CASE WHEN lv * w <= cap THEN lv END) OVER () AS level FROM s1),
s AS (SELECT source, source_size, place, total,
             CASE WHEN level IS NULL OR level * w > cap THEN CAST(cap AS DOUBLE) ELSE level * w END AS target,
             CAST(ceil(n_rows / {float(shard_rows)}) AS BIGINT) AS n_shards,
             CASE WHEN total > 0 THEN greatest(1, CAST(floor((total + {block / 2}) / {block}) AS BIGINT)) ELSE 0 END
               AS blocks FROM s2),
sk AS (SELECT *, unnest(range(CAST(ceil(2 * target / {block}) AS BIGINT) + 8)) AS k FROM s WHERE target > 0),
sq AS (SELECT place, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k)
              AS rk FROM sk) WHERE rk <= blocks GROUP BY place),
r AS (SELECT d.*, s.source_size, s.target, s.place, s.n_shards, coalesce(sq.quota, 0) AS seats,
             CAST('0x' || substr(d.draw, 1, 8) AS BIGINT) % s.n_shards AS shard
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN sq ON sq.place = s.place),
sh AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(seats) AS seats FROM r
       GROUP BY place, shard),
hk AS (SELECT *, unnest(range(CAST(least(seats, ceil(4.0 * shard_size / {block}) + 8) AS BIGINT))) AS k
       FROM sh WHERE shard_size > 0),
hq AS (SELECT place, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY place
              ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS rk FROM hk) WHERE rk <= seats GROUP BY place, shard),
l AS (SELECT r.*, sh.shard_size, least(coalesce(hq.quota, 0) * {block}, sh.shard_size * {cap}) AS words,
             coalesce(CAST(sum(r.size) OVER (PARTITION BY r.place, r.shard ORDER BY r.draw, r.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
      FROM r JOIN sh ON sh.place = r.place AND sh.shard = r.shard
      LEFT JOIN hq ON hq.place = r.place AND hq.shard = r.shard),
t AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds FROM l)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(size, words - rounds * shard_size - start)) AS BIGINT) AS taken FROM t"""
