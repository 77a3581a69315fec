"""Operator 4, line dedup by winnowing over line hashes.

Lines are compared without outer and repeated white space and without case; blank lines do not
count and stay.  A fingerprint is the hash of ``GRAM`` lines in a row; of every ``WINDOW``
fingerprints in a row the smallest is selected (the last of equals), so every repeated run of
``GRAM + WINDOW - 1`` lines shares a selected one.  A line of ``LONG`` words or more is a run by
itself and always selected.  Each selected position joins the first place where its fingerprint
was selected (smallest id, then row, then line), and the match is extended both ways over the neighbouring
lines, ``WINDOW`` lines each way: beyond them the next selected position takes over.  The later run is
deleted; the first stays.

Scale: one pass over the texts; after it only selected positions with a few neighbour hashes
move.  First places come from a min-aggregate that combines before the shuffle; the join
back is on a stored table, so adaptive execution splits a line that a third of all documents hold.
Nothing is collected per line or group; positions are gathered per document only.

Defined cases: very long texts are taken whole, one at a time in a task;
null text is the empty text; documents without lines come back unchanged; null
ids come after all others; repeated rows and ids are documents of their own, of which the first
stays; lines repeated inside one document are runs like any other; an empty table gives an empty
result; other columns are not read (``dedup`` hands them on).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, pick, store

GRAM = 2
WINDOW = 2
LONG = 50
NONE = b""


def line_hashes(text: str | None) -> tuple[list[int], list[bytes], list[int]]:
    """Numbers, hashes (16 bytes) and word counts of the lines that are not blank."""
    at, out, n = [], [], []
    for k, line in enumerate((text or "").split("\n")):
        w = line.lower().split()
        if w:
            at.append(k)
            out.append(xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "replace")))
            n.append(len(w))
    return at, out, n


def selected(hashes: list[bytes], n_words: list[int], gram: int = GRAM, window: int = WINDOW, long: int = LONG):
    """(first line, lines, fingerprint) of the selected positions."""
    grams = [xxhash.xxh3_128_digest(b"".join(hashes[i:i + gram])) for i in range(len(hashes) - gram + 1)]
    chosen = set()
    for i in range(max(0, len(grams) - window + 1)):
        part = range(i, i + window)
        chosen.add(min(part, key=lambda k: (grams[k], -k)))
    if grams and len(grams) < window:
        chosen.add(min(range(len(grams)), key=lambda k: (grams[k], -k)))
    for i in sorted(chosen):
        yield i, gram, grams[i]
    for i, (h, n) in enumerate(zip(hashes, n_words, strict=True)):
        if n >= long:
            yield i, 1, h


def spots(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(doc_id, text, ..) -> ``row``, every column but text, ``lines`` (numbers in the text), ``spots``."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([T.StructField("row", T.LongType()), *rest, T.StructField("lines", T.ArrayType(T.IntegerType())),
                           T.StructField("spots", T.ArrayType(T.StructType.fromDDL(
                               "print binary, line int, span int, left array<binary>, right array<binary>")))])
    spot = pa.struct([("print", pa.binary()), ("line", pa.int32()), ("span", pa.int32()),
                      ("left", pa.list_(pa.binary())), ("right", pa.list_(pa.binary()))])

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            lines, found = [], []
            for t in b.column("text"):
                at, h, n = line_hashes(t.as_py())
                lines.append(at)
                found.append([{"print": p, "line": i, "span": s, "left": h[max(0, i - window):i][::-1],
                               "right": h[i + s:i + s + window]} for i, s, p in selected(h, n, gram, window, long)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + b.num_rows)), *(b.column(f.name) for f in rest),
                 pa.array(lines, pa.list_(pa.int32())), pa.array(found, pa.list_(spot))], names=schema.names)
            row += b.num_rows

    return docs.mapInArrow(run, schema)


def _agree(a: str, b: str):
    """How many first elements of two arrays agree."""
    same = F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")),
                       lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def later_runs(found: DataFrame) -> DataFrame:
    """(row, first, last): lines, counted without blank ones, of the runs that repeat an earlier place."""
    each = found.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("doc"),
                        F.explode("spots").alias("s")).select("doc", "s.*")
    place = F.struct("doc", "line")
    first = store(each.groupBy("print", "span").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "line", "left", "right")).alias("f")).where("n > 1")
        .select("print", "span", F.struct("f.doc", "f.line").alias("place"), F.col("f.left").alias("left0"),
                F.col("f.right").alias("right0")))
    pairs = each.join(first, ["print", "span"]).where(place != F.col("place"))
    return pairs.select(F.col("doc.row").alias("row"), (F.col("line") - _agree("left", "left0")).alias("first"),
                        (F.col("line") + F.col("span") - 1 + _agree("right", "right0")).alias("last"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                   window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): ``removed`` are the numbers of deleted lines in the text, from 0."""
    found = store(spots(pick(docs, doc_id=id_col, text=text_col), gram, window, long))
    return _marked(found).select("doc_id", F.size("lines").alias("n_lines"), F.size("removed").alias("n_removed"),
                                 "removed")


def _marked(found: DataFrame) -> DataFrame:
    gone = (later_runs(found).select("row", F.explode(F.sequence("first", "last")).alias("k")).distinct()
            .groupBy("row").agg(F.array_sort(F.collect_list("k")).alias("gone")))
    none = F.array().cast("array<int>")
    return found.drop("spots").join(gone, "row", "left").withColumn(
        "removed", F.transform(F.coalesce("gone", none), lambda k: F.get(F.col("lines"), k))).drop("gone")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW,
          long: int = LONG) -> DataFrame:
    """The rows and columns of ``docs`` with the later runs deleted from the text."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    found = store(spots(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), doc),
                        gram, window, long))
    text = F.col(f"doc.`{text_col}`")
    kept = let(F.split(text, "\n", -1), lambda x: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)))
    cut = F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(text)
    return _marked(found).select(*[cut.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
