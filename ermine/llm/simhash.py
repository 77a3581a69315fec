"""Operator 1, SimHash near-dedup with bit-sliced comparison.

Fingerprints are 64-bit majority votes over the hashes of word shingles.  Two
fingerprints link at ``radius`` or fewer differing bits.  Candidates come from an exact
pigeonhole index: 64 bits in ``blocks`` blocks, and each choice of ``blocks - radius``
of them is a table, so any two fingerprints within the radius share a bucket of some
table.  Inside a bucket the bits lie vertically (plane p holds bit p of 64 fingerprints
per word); carry-save counters add 64 distances at a time and a block is abandoned once
every lane has passed the radius.

Scale: ``blocks`` follows the number of distinct fingerprints (a bucket should hold about
a word of lanes), which changes the cost and never the links.  Buckets above ``unit``
rows are dealt as pairs of parts, so no task holds a whole bucket.  Tasks put out a
spanning forest of what they find, never all pairs.  Equal fingerprints are one node.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows
are kept one by one, repeated or null ids too; a component's id is its smallest non-null
id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, placed, store
from .components import components

SEED = 42
UNIT = 512       # rows of a bucket compared in one piece
ENTRIES = 16384  # (row, word of lanes) pairs per vector step
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text; zero without words."""
    words = (text or b"").lower().split()
    k = min(shingle, len(words))
    if not k:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at:at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(.., text) -> the same columns without text, and ``fp`` (the 64 bits as a signed long)."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(fps.view(np.int64))],
                                             names=[*(f.name for f in rest), "fp"])

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def table_count(n: int, radius: int) -> int:
    """Blocks so that the ``n`` fingerprints leave about 64 a bucket, radius + 2 at least."""
    b = radius + 2
    while n > 64 << (64 * (b - radius) // b) and b < 2 * radius + 6:
        b += 1
    return b


def _keys(radius: int, blocks: int) -> list:
    """One (table, key) struct per choice of blocks that must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    return out


def _planes(fps: np.ndarray) -> np.ndarray:
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _lanes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Masks of the lanes lo .. hi - 1 (0 <= lo <= hi <= 64)."""
    low = lambda n: np.where(n >= 64, ONES, (np.uint64(1) << (n & 63).astype(np.uint64)) - np.uint64(1))
    return low(hi) & ~low(lo)


def links(fps: np.ndarray, ends: np.ndarray, radius: int):
    """Pairs (i, j), i < j < ends[i], within the radius; ``ends``: where each row's group ends."""
    planes, rows = _planes(fps), np.arange(len(fps))
    first, last = (rows + 1) >> 6, (ends - 1) >> 6
    counts = np.where(ends > rows + 1, last - first + 1, 0)
    upto = np.cumsum(counts)
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius  # a counter that overflows at radius + 1
    total = int(upto[-1]) if len(upto) else 0
    for at in range(0, total, ENTRIES):
        entry = np.arange(at, min(total, at + ENTRIES))
        row = np.searchsorted(upto, entry, side="right")
        word = first[row] + entry - (upto[row] - counts[row])
        ok = _lanes(np.clip(row + 1 - word * 64, 0, 64), np.clip(ends[row] - word * 64, 0, 64))
        mine = fps[row]
        count = [np.full(len(row), ONES if start >> i & 1 else 0, np.uint64) for i in range(width)]
        over = np.zeros(len(row), np.uint64)
        for p in range(0, 64, 2):
            x, y = (planes[q][word] ^ (np.uint64(0) - ((mine >> np.uint64(q)) & np.uint64(1))) for q in (p, p + 1))
            half = count[0] ^ x
            carry = (count[0] & x) | (half & y)
            count[0] = half ^ y
            for i in range(1, width):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
            if p % 16 == 14:
                alive = np.flatnonzero(ok & ~over)
                if len(alive) < len(row) * 0.7:
                    row, word, ok, mine, over = row[alive], word[alive], ok[alive], mine[alive], over[alive]
                    count = [c[alive] for c in count]
                    if not len(row):
                        break
        found = ok & ~over
        hit = np.flatnonzero(found)
        if len(hit):
            bits = np.unpackbits(found[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, lane = np.nonzero(bits)
            yield row[hit][e], word[hit][e] * 64 + lane


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs: every group carries its smallest index."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped


def _forest(radius: int):
    def flush(fps, group):
        cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        size = np.diff(np.r_[cut, len(fps)])
        label = np.arange(len(fps))
        for i, j in links(fps, np.repeat(cut + size, size), radius):
            label = merge(label, i, j)
        own = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[own].view(np.int64)), pa.array(fps[label[own]].view(np.int64))],
                                          names=["u", "v"])

    def run(batches):
        fps, group = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        for b in batches:
            col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("t", "key", "lo", "hi", "fp")}
            fps = np.r_[fps, col["fp"].view(np.uint64)]
            group = np.r_[group, np.stack([col[n].astype(np.int64) for n in ("t", "key", "lo", "hi")], axis=1)]
            if len(fps):  # the last group may go on in the next batch; a group is 2 units at most, give or take
                keep = np.flatnonzero((group != group[-1]).any(axis=1))
                done = keep[-1] + 1 if len(keep) else 0
                if done:
                    yield flush(fps[:done], group[:done])
                    fps, group = fps[done:], group[done:]
        if len(fps):
            yield flush(fps, group)

    return run


def near_links(fps: DataFrame, radius: int = 4, blocks: int | None = None, unit: int = UNIT) -> DataFrame:
    """Distinct ``fp`` -> edges (u, v) whose components are those of all pairs within the radius."""
    blocks = blocks or table_count(fps.count(), radius)
    keyed = fps.select(F.explode(F.array(*_keys(radius, blocks))).alias("k"), "fp").select("k.t", "k.key", "fp")
    shared = store(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / unit).cast("long")
    rows = (keyed.join(shared, ["t", "key"])
            .withColumn("part", F.pmod(F.xxhash64("fp"), parts))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            .select("t", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp"))
    unit_of = ["t", "key", "lo", "hi"]
    return (rows.repartition(*unit_of).sortWithinPartitions(*unit_of, "fp")
            .mapInArrow(_forest(radius), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp``, ``component_id`` (smallest id reachable)."""
    return classes(pick(docs, doc_id=id_col, text=text_col), shingle, radius).drop("root")


def classes(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(doc_id, text, ..) -> every column but text, ``fp``, ``root`` (of the component) and ``component_id``."""
    rows = store(fingerprints(docs, shingle))
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = store(components(near_links(nodes.select("fp"), radius)))
    rooted = store(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                   .withColumn("root", F.coalesce("root", "fp")))
    least = store(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of = store(rooted.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(of, "fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
               radius: int = 4, scan: bool = False) -> DataFrame:
    """The input's rows and columns, one row of each component: smallest id, then first by file and place.

    ``scan``: ``docs`` is a plain scan of stored files (see :func:`placed`); else it is stored first.
    """
    rows = placed(docs, scan)
    cls = store(classes(rows.select(F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"),
                                    "file", "at"), shingle, radius))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("file"), F.col("at"))
    first = store(cls.groupBy("root").agg(F.min(order).alias("o")).select("o.file", "o.at"))
    # one plan at every size: a merge join, whatever the size of the kept rows
    return rows.join(first.hint("merge"), ["file", "at"]).select("doc.*")
