"""Operator 8, token counts by overlap resynchronisation.

Texts up to ``CHUNK`` characters are encoded whole.  A huge text is encoded in chunks that
overlap, with offsets, and neighbours are spliced at a common boundary: a position where a
token begins in both encodings and which is proven stable, a space after a character that is no
white space.  No pre-token of a byte-level model reaches over such a place from either side, so the
left encoding is that of the text up to it and the right one that of the text from it on.
Where the overlap holds no such place, it is widened, twofold each time; where it would reach
the chunk's own beginning, the chunk itself grows.  A text without any such place ends up encoded
whole.  Special strings inside texts are handled as the library does by default.

Scale: one map pass without a shuffle; offsets are held for one chunk at a time.

Defined cases: null text is empty, 0 bytes and 0 tokens; repeated rows and ids are rows like any
other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick
from .records import Encoder, batches_of, encoder

CHUNK = 1 << 15     # characters
OVERLAP = 1 << 9
LIMIT = 1024


def _starts(own: Encoder, text: str, at: int) -> np.ndarray:
    """Where the tokens of ``text`` begin, ``at`` characters further on."""
    offsets = own.library.encode(text, add_special_tokens=False).offsets
    return at + np.fromiter((a for a, _ in offsets), np.int64, len(offsets))


def _splice(text: str, left: np.ndarray, right: np.ndarray, lo: int, end: int) -> int | None:
    """A stable common boundary in (lo, end), the middle one."""
    both = np.intersect1d(left[left > lo], right[(right > lo) & (right < end - 1)])
    stable = [p for p in both.tolist() if text[p] == " " and not text[p - 1].isspace()]
    return stable[len(stable) // 2] if stable else None


def count_huge(own: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length from overlapping chunks."""
    total, begin, end = 0, 0, min(len(text), chunk)
    left = _starts(own, text[:end], 0)
    while end < len(text):
        width = overlap
        while (lo := end - width) > begin:
            upto = min(len(text), lo + max(chunk, 2 * width))
            right = _starts(own, text[lo:upto], lo)
            if (p := _splice(text, left, right, lo, end)) is not None:
                total += int(((left >= begin) & (left < p)).sum())
                begin, end, left = p, upto, right
                break
            width *= 2
        else:  # no stable place after ``begin``: a longer chunk from there
            end = min(len(text), begin + 2 * (end - begin))
            left = _starts(own, text[begin:end], begin)
    return total + int((left >= begin).sum())


def counts(own: Encoder, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out = [0] * len(texts)
    huge = [k for k, t in enumerate(texts) if len(t) > chunk and own.splits]
    rest = [k for k, t in enumerate(texts) if not (len(t) > chunk and own.splits)]
    for k in huge:
        out[k] = count_huge(own, texts[k], chunk, overlap)
    for s in batches_of([texts[k] for k in rest]):
        for k, ids in zip(rest[s], own.encode_bytes([texts[k] for k in rest[s]]), strict=True):
            out[k] = len(ids) // 4
    return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    schema = T.StructType([d.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches):
        own = encoder(tokenizer)
        for b in batches:
            n = pa.array(counts(own, b.column("text").to_pylist(), chunk, overlap), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=schema.names)

    d = d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return d.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
