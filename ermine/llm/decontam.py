"""Operator 9, benchmark decontamination.

Texts are lower-cased, ASCII punctuation is dropped, words are split at white space, and
shingles are five words (a shorter text is one shingle).  For each benchmark item, every
window of a document with as many words as the item is a candidate where it holds at
least one of the item-set's shingles: a window without one has similarity 0, so nothing is
lost.  Each window gets a 64-bit SimHash (rolling bit sums); a multi-index over the
items of that length looks it up: the 64 bits lie in ``RADIUS + 1`` blocks, so an item
within the radius agrees in one block at least.  What the index finds is verified by the
exact weighted similarity, sum of min counts over sum of max counts of the shingles,
``SIMILARITY`` or more.  At that similarity two fingerprints differ in about 10 bits (standard
deviation 3), so the radius of 24 loses none that could be measured.

Scale: documents are read in one map pass without a shuffle.  Items travel as broadcast
blocks of at most ``ITEM_WORDS`` words; a larger benchmark takes more passes, one per block.

Defined cases: null and wordless texts match nothing, and neither do null or wordless items; items
under five words match windows of their own length; repeated items, ids and documents
each keep their rows; empty tables give empty results (``drop_contaminated`` without items
keeps every row); other columns are not read (``drop_contaminated`` hands them on).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
ITEM_WORDS = 2_000_000   # words of the items in one broadcast block
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BITS = 1 << 20           # of the table that rules most shingles out


def word_hashes(text: str | None) -> np.ndarray:
    w = (text or "").lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray) -> np.ndarray:
    """One hash per window of five words; fewer words are one shingle."""
    n = min(SHINGLE, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = _mix(out * MULTIPLIER + h[i:len(h) - n + 1 + i])
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhashes(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of ``width`` shingles."""
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(_bits(h), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[width:] - sums[:-width]) > width, axis=1, bitorder="little").view(np.uint64)[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle multisets."""
    keys, which = np.unique(np.r_[a, b], return_inverse=True)
    x, y = (np.bincount(w, minlength=len(keys)) for w in (which[:len(a)], which[len(a):]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """The items of a block, by length, with a multi-index over their fingerprints."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items, self.by_width = [], defaultdict(list)
        for key, text in items:
            h = word_hashes(text)
            if len(h):
                s = shingles(h)
                self.by_width[len(h)].append(len(self.items))
                self.items.append((key, s, simhashes(s, len(s))[0]))
        self.blocks, edges = [], [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            self.blocks.append((np.uint64(a), np.uint64((1 << (b - a)) - 1)))
        self.tables = {}
        for width, own in self.by_width.items():
            f = np.array([self.items[i][2] for i in own], np.uint64)
            order = [np.argsort((f >> a) & m, kind="stable") for a, m in self.blocks]
            self.tables[width] = (np.array(own), f, [(o, ((f >> a) & m)[o]) for o, (a, m) in
                                                     zip(order, self.blocks, strict=True)])
        # anchors: shingles of items of five words or more, and of each shorter length
        self.anchors = {}
        for n in {min(w, SHINGLE) for w in self.by_width}:
            h = np.unique(np.concatenate([s for w, own in self.by_width.items() if min(w, SHINGLE) == n
                                          for s in (self.items[i][1] for i in own)]))
            table = np.zeros(BITS, bool)
            table[(h & np.uint64(BITS - 1)).astype(np.int64)] = True
            widths = defaultdict(set)  # of the items that hold the anchor
            for w, own in self.by_width.items():
                if min(w, SHINGLE) == n:
                    for i in own:
                        for x in np.unique(self.items[i][1]).tolist():
                            widths[x].add(w)
            self.anchors[n] = (h, table, dict(widths))

    def lookup(self, fps: np.ndarray, width: int):
        """(window, item) pairs within the radius, through the blocks."""
        own, f, tables = self.tables[width]
        found = []
        for (a, m), (order, values) in zip(self.blocks, tables, strict=True):
            v = (fps >> a) & m
            lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(fps)), n)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(window))
            found.append(window * len(own) + order[at])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(own), pair % len(own)
        far = np.bitwise_count(fps[window] ^ f[item])
        near = far <= RADIUS
        return window[near], own[item[near]], far[near]

    def matches(self, text: str | None):
        """(item number, start word, words, differing bits, similarity): the best window of each item."""
        h = word_hashes(text)
        best: dict[int, tuple] = {}
        for n, (anchors, table, widths) in self.anchors.items():
            if len(h) < n:
                continue
            s = shingles(h) if n == SHINGLE else np.concatenate([shingles(h[i:i + n]) for i in range(len(h) - n + 1)])
            hit = np.flatnonzero(table[(s & np.uint64(BITS - 1)).astype(np.int64)])
            if not len(hit):
                continue
            at = np.searchsorted(anchors, s[hit])
            hit = hit[anchors[np.minimum(at, len(anchors) - 1)] == s[hit]]
            spots = defaultdict(list)
            for p in hit.tolist():
                for w in widths[int(s[p])]:
                    spots[w].append(p)
            for w, own in spots.items():
                span = w - n + 1  # shingles of a window
                for lo, hi in _regions(own, span, len(s)):
                    fps = simhashes(s[lo:hi], span)
                    for k, i, far in zip(*self.lookup(fps, w), strict=True):
                        sim = similarity(s[lo + k:lo + k + span], self.items[i][1])
                        if sim >= SIMILARITY and (i not in best or sim > best[i][3]):
                            best[i] = (int(lo + k), w, int(far), sim)
        return [(i, *b) for i, b in sorted(best.items())]


def _regions(spots: list[int], span: int, n: int):
    """Stretches of shingles that hold every window of ``span`` with a spot inside."""
    lo = hi = None
    for p in spots:
        a, b = max(0, p - span + 1), min(n, p + span)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None and hi - lo >= span:
            yield lo, hi
        lo, hi = a, b
    if hi is not None and hi - lo >= span:
        yield lo, hi


def _blocks(benchmark: DataFrame, block_words: int):
    """The items in blocks of bounded size, one at a time on the driver."""
    items = benchmark.where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_words * 6)))
    for i in range(n):
        own = items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n)) == i)
        rows = [(r["item_id"], r["text"]) for r in own.collect()]
        if rows:
            yield rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  block_words: int = ITEM_WORDS) -> DataFrame:
    """One row per document row and item found in it: ``doc_id``, ``item_id``, ``start`` (word), ``n_words``,
    ``bits`` (differing), ``similarity`` of the best window."""
    d, bench = pick(docs, doc_id=id_col, text=text_col), pick(benchmark, item_id=item_col, text=item_text_col)
    schema = T.StructType([d.schema["doc_id"], bench.schema["item_id"], T.StructField("start", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("bits", T.IntegerType()),
                           T.StructField("similarity", T.DoubleType())])
    out = None
    for rows in _blocks(bench, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for b in batches:
                found = [(k, *m) for k, t in enumerate(b.column("text")) for m in index.matches(t.as_py())]
                if found:
                    k, i, *rest = zip(*found, strict=True)
                    items = pa.array([index.items[x][0] for x in i])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(k)), items,
                         *(pa.array(v, t) for v, t in zip(rest, (pa.int64(), pa.int64(), pa.int32(), pa.float64()),
                                                          strict=True))], names=schema.names)

        part = d.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", block_words: int = ITEM_WORDS) -> DataFrame:
    """The rows and columns of ``docs`` in which no item is found."""
    at = docs.columns.index(text_col)
    for rows in _blocks(pick(benchmark, item_id=item_col, text=item_text_col), block_words):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
