"""Operator 2, language-model scores from a probabilistic suffix tree.

A text is its lower-cased words joined by one space and closed by an end mark, as UTF-8 bytes, so
each sequence of words has one spelling and the model's probability is one over word sequences.
Symbols are bytes.  A context of up to ``DEPTH`` bytes becomes a node of the tree if it occurs ``LEAST`` times or
more and its next-symbol distribution diverges from that of the context one byte shorter: occurrences times
Kullback-Leibler divergence is ``EVIDENCE`` or more for each distinct next symbol.  Both tests count occurrences, not
shares, so the tree grows with the training texts.  A node's distribution is
smoothed with ``WEIGHT`` pseudo-counts a distinct next symbol, spread like its nearest retained suffix; the
root is smoothed with the uniform distribution over 256 bytes.  Each position is scored by its longest retained
suffix: sorted tables, one for each context length, are searched for the distinct (context, next) pairs of a stretch.

The base score needs every word's training count.  Words that make up at least ``COMMON`` of the training
tokens are broadcast, the counts of all others meet the documents in a join.

Scale: n-gram and word counts combine in each task (bounded memory, flushed) and again after one shuffle.  The tree
is a stored table.  It is dealt into pieces of about ``PIECE`` rows by the two latest bytes of the context (a context
and all its suffixes of two bytes or more share a piece; the few shorter ones go with every piece).  The driver
takes one piece at a time and broadcasts it; a pass over the texts scores the positions of ``PER_PASS`` pieces, and there
are as many passes as the tree needs, so neither the driver nor a worker holds more than that.  Common words are at
most 1 / COMMON.  Words are compared by 64-bit hash.  Very long texts are counted and scored in stretches.

Defined cases: null text is the empty text (one token, the end); a null id trains; repeated rows and ids
each train and are each scored; without training rows every distribution is uniform and counts are 0; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, pick, store

DEPTH = 6            # with the next byte, one 64-bit key; 7 at most
LEAST = 4
EVIDENCE = 1.0
WEIGHT = 4.0
PIECE = 1 << 19
PER_PASS = 6
COMMON = 2e-7
END = 10             # byte of the end mark, which no word and no space can be
STREAM = 1 << 21     # bytes per vector step
FLUSH = 1 << 21      # distinct n-grams or words a task holds


def canonical(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def streams(texts, size: int = STREAM):
    """Texts in groups: their bytes, each after DEPTH end marks and closed by one, where each begins, and words."""
    parts, starts, words, at = [], [], [], 0
    for t in texts:
        w = canonical(t)
        s = b" ".join(w)
        parts += [bytes([END]) * DEPTH, s, bytes([END])]
        starts.append(at + DEPTH)
        words.append(w)
        at += DEPTH + len(s) + 1
        if at >= size:
            yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), words
            parts, starts, words, at = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), words


def keys(stream: np.ndarray, starts: np.ndarray):
    """(first place, scored places from there, their keys) of each stretch; key: next byte, then its context, latest
    byte first, from the highest byte down."""
    scored = np.ones(len(stream), bool)
    for k in range(1, DEPTH + 1):
        scored[starts - k] = False
    for a in range(0, len(stream), STREAM):
        low = max(0, a - DEPTH)
        part = stream[low:a + STREAM].astype(np.uint64)
        key = part << np.uint64(8 * DEPTH)
        for k in range(1, DEPTH + 1):
            key[k:] |= part[:-k] << np.uint64(8 * (DEPTH - k))
        here = np.flatnonzero(scored[a:a + STREAM])
        yield a, here, key[a - low:][here]


def grams(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts."""
    key = np.sort(key)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[:len(key)]
    return key[cut], np.diff(np.r_[cut, len(key)])


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[cut], np.add.reduceat(n, cut)


def _rows(key, n):
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])


def gram_counts(train: DataFrame) -> DataFrame:
    """(text as bytes) -> (key, n) over all training positions, combined in each task only."""
    def run(batches):
        held = []
        for b in batches:
            for stream, starts, _ in streams(x.as_py() for x in b.column(0)):
                for _, _, key in keys(stream, starts):
                    held.append(grams(key))
                    if len(held) > 8 or sum(len(k) for k, _ in held) > FLUSH:
                        held = [_sum(held)]
                        if len(held[0][0]) > FLUSH:
                            yield _rows(*held.pop())
        if held:
            yield _rows(*_sum(held))

    return train.mapInArrow(run, "key long, n long")


def word_hash(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64).view(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """(text as bytes) -> (key, n): the hash of each training token (the end is the empty word) and its count."""
    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                held.update(canonical(x.as_py()))
                if len(held) > FLUSH:
                    yield _rows(word_hash(held), list(held.values()))
                    held = Counter()
            if b.num_rows:
                held[b""] += b.num_rows
        if held:
            yield _rows(word_hash(held), list(held.values()))

    return train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _level(counts: DataFrame, d: int) -> DataFrame:
    """(ctx, key, n, total) of contexts of ``d`` bytes: one shuffle by context, in which a context has 256 keys at most."""
    ctx = F.expr(f"key & {(1 << 8 * d) - 1}L")
    own = counts.repartition(ctx).withColumn("ctx", ctx).groupBy("ctx", "key").agg(F.sum("n").alias("n"))
    own = own.withColumn("total", F.sum("n").over(Window.partitionBy("ctx")))
    return store(own.drop("ctx")).withColumn("ctx", ctx)


def retained(counts: DataFrame, least: int = LEAST, evidence: float = EVIDENCE) -> DataFrame:
    """(d, key, n, two): next-symbol counts of the root and of each context that passes the tests; ``two`` are the
    two latest bytes, null for shorter contexts."""
    own, kept = _level(counts, DEPTH), []
    for d in range(DEPTH, 0, -1):
        shorter = _level(own.select(F.shiftrightunsigned("key", 8).alias("key"), "n"), d - 1)
        kept.append(_diverging(own.where(F.col("total") >= least), shorter, evidence)
                    .select(F.lit(d).alias("d"), "key", "n",
                            F.shiftright("ctx", 8 * (d - 2)).cast("int").alias("two") if d > 1
                            else F.lit(None).cast("int").alias("two")))
        own = shorter
    out = own.select(F.lit(0).alias("d"), "key", "n", F.lit(None).cast("int").alias("two"))
    for k in kept:
        out = out.unionByName(k)
    return store(out)


def _diverging(own: DataFrame, shorter: DataFrame, evidence: float) -> DataFrame:
    """The rows of ``own`` whose context passes against the context one byte shorter."""
    up = shorter.select(F.col("key").alias("up"), (F.col("n") / F.col("total")).alias("q"))
    both = own.withColumn("up", F.shiftrightunsigned("key", 8)).join(up, "up")
    w = Window.partitionBy("ctx")
    return (both.withColumn("g", F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).over(w))
            .withColumn("kinds", F.count(F.lit(1)).over(w)).where(F.col("g") >= evidence * F.col("kinds")))


def piece_of(two, pieces: int):
    """The piece of a context by its two latest bytes; for columns and arrays alike."""
    return (two * 40503 % 65536) * pieces / 65536


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return table[at] == key, at


def _context(key: np.ndarray, d: int) -> np.ndarray:
    return key & np.uint64((1 << 8 * d) - 1)


class Tree:
    """For each context length, sorted (context, next) pairs with their smoothed probability, and sorted contexts with
    the share that they leave to shorter ones."""

    def __init__(self, d: np.ndarray, key: np.ndarray, n: np.ndarray, weight: float = WEIGHT):
        self.pair, self.prob, self.context, self.rest = [], [], [], []
        for size in range(DEPTH + 1):
            mine = d == size
            order = np.argsort(key[mine])
            pair, m = key[mine][order], n[mine][order]
            context, of, kinds = np.unique(_context(pair, size), return_inverse=True, return_counts=True)
            held = weight * kinds  # pseudo-counts: a node with many followers trusts its counts less
            total = np.bincount(of, m, minlength=len(context)) + held
            lower = self.probability(pair >> np.uint64(8), size - 1) if size else 1 / 256
            self.pair.append(pair)
            self.prob.append((m + held[of] * lower) / total[of])
            self.context.append(context)
            self.rest.append(held / total)

    def probability(self, key: np.ndarray, top: int) -> np.ndarray:
        """Probability of each (context, next) pair of up to ``top`` bytes by the longest retained suffix."""
        out, left = np.ones(len(key)), np.arange(len(key))
        for d in range(top, -1, -1):
            k = key[left] >> np.uint64(8 * (top - d))
            found, at = _find(self.pair[d], k)
            out[left[found]] *= self.prob[d][at[found]]
            left, k = left[~found], k[~found]
            known, at = _find(self.context[d], _context(k, d))
            out[left[known]] *= self.rest[d][at[known]]
        out[left] /= 256
        return out

    def score(self, stream: np.ndarray, starts: np.ndarray, mine=None) -> np.ndarray:
        """log10 probability of each text of a stream, over the positions whose two latest bytes are in ``mine``."""
        flat = np.zeros(len(stream))
        for a, here, key in keys(stream, starts):
            if mine is not None:
                inside = mine[_context(key, DEPTH) >> np.uint64(8 * (DEPTH - 2))]
                here, key = here[inside], key[inside]
            pairs, of = np.unique(key, return_inverse=True)
            flat[a + here] = np.log10(self.probability(pairs, DEPTH))[of]
        return np.add.reduceat(flat, starts)


_BUILT: dict[str, Tree] = {}


def _tree(name: str, parts: list) -> Tree:
    """The tree of the broadcast ``parts``, built once in each Python worker; only the latest is held."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Tree(*(np.concatenate(x) for x in zip(*(p.value for p in parts), strict=True)))
    return _BUILT[name]


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = rows.select(F.col("d").cast("byte"), "key", "n").toPandas()
    return t["d"].to_numpy(np.int8), t["key"].to_numpy(np.int64).view(np.uint64), t["n"].to_numpy(np.int64)


def passes(spark, tree: DataFrame):
    """(broadcast parts, the two latest bytes they are for) of each pass over the texts; the driver drops the parts of
    a pass when the next is asked for, by when the pass's scores must be written."""
    sc, two = spark.sparkContext, np.arange(65536, dtype=np.int64)
    pieces = -(-tree.count() // PIECE) or 1
    short = sc.broadcast(_collected(tree.where("two is null")))
    for low in range(0, pieces, PER_PASS):
        high = min(low + PER_PASS, pieces)
        parts = [short, *(sc.broadcast(_collected(
            tree.where(F.floor(piece_of(F.col("two").cast("long"), pieces)) == k))) for k in range(low, high))]
        of = piece_of(two, pieces).astype(np.int64)
        yield parts, ((of >= low) & (of < high)) if high - low < pieces else None
        for p in parts[1:]:
            p.destroy()
    short.destroy()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
          evidence: float = EVIDENCE, common: float = COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``."""
    d = (pick(docs, doc_id=id_col, text=text_col)
         .select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), F.col("text").cast("binary").alias("text")))
    train = d.where(~F.col("held_out")).select("text")
    sc = docs.sparkSession.sparkContext
    tree = retained(gram_counts(train), least, evidence)
    words = store(word_counts(train))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    is_common = F.col("n") >= common * n  # at most 1 / common words
    top = words.where(is_common).toPandas().sort_values("key")
    often = sc.broadcast((top["key"].to_numpy(np.int64), np.log10(top["n"].to_numpy(np.float64) + 1)))
    schema = T.StructType([*(f for f in d.schema.fields if f.name != "text"), *(
        T.StructField(c, t) for c, t in (("row", T.LongType()), ("score", T.DoubleType()), ("n_tokens", T.LongType()),
                                         ("known", T.LongType()), ("logs", T.DoubleType()),
                                         ("rare", T.ArrayType(T.LongType()))))])

    def scorer(parts, mine, whole):
        """Score of the pass's positions by row; ``whole``: with the other columns."""
        name = uuid.uuid4().hex

        def run(batches):
            from pyspark import TaskContext

            model = _tree(name, parts)
            row = TaskContext.get().partitionId() << 40
            for b in batches:
                at = 0
                for stream, starts, words in streams(x.as_py() for x in b.column("text")):
                    m = len(words)
                    own = {"row": pa.array(np.arange(row, row + m)), "score": pa.array(model.score(stream, starts, mine))}
                    if whole:
                        own |= {c: b.column(c).slice(at, m) for c in ("doc_id", "held_out")}
                        own |= known_words(words)
                    names = [f.name for f in schema if f.name in own]
                    yield pa.RecordBatch.from_arrays([own[c] for c in names], names=names)
                    row, at = row + m, at + m

        return run

    def known_words(words):
        keys, logs = often.value
        n_tokens = np.array([len(w) + 1 for w in words])
        first = np.cumsum(n_tokens) - n_tokens
        h = word_hash(x for w in words for x in (*w, b""))
        spot = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        known = keys[spot] == h if len(keys) else np.zeros(len(h), bool)
        log = np.where(known, logs[spot] if len(keys) else 0.0, 0.0)
        n_known = np.add.reduceat(known.astype(np.int64), first)
        rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_tokens - n_known)], pa.int32()), pa.array(h[~known]))
        return {"n_tokens": pa.array(n_tokens), "known": pa.array(n_known), "logs": pa.array(np.add.reduceat(log, first)),
                "rare": rare}

    scored, more = None, []
    for parts, mine in passes(docs.sparkSession, tree):
        if scored is None:
            if mine is not None:  # rows are numbered by task and place: every pass must read the same files
                d = store(d)
            scored = store(d.mapInArrow(scorer(parts, mine, True), schema))
        else:
            more.append(store(d.select("text").mapInArrow(scorer(parts, mine, False), "row long, score double")))
    often.destroy()
    if more:
        every = scored.select("row", "score")
        for x in more:
            every = every.unionByName(x)
        scored = scored.drop("score").join(every.groupBy("row").agg(F.sum("score").alias("score")), "row")
    rare = scored.select("row", F.explode("rare").alias("key"))
    # words that training never met add log10(1) = 0 and are not known: an inner join will do
    sums = (rare.join(words.where(~is_common), "key").groupBy("row")
            .agg(F.sum(F.log10(F.col("n") + 1)).alias("more_logs"), F.count(F.lit(1)).alias("more_known")))
    zero = F.lit(0)
    base = F.col("logs") + F.coalesce("more_logs", zero) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return (scored.drop("rare").join(sums, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"))
