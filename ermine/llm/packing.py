"""Operator 11, best-fit packing of documents into sequences of a fixed length.

Each task reads documents one after the other and keeps at most ``open_bins`` sequences open.  A bitset with one bit
for each free space says which spaces the open sequences have: the lowest bit at or above a piece's length is the best
fit.  A piece that fits nowhere opens a sequence; if too many are open by then, the fullest closes first.

What a task leaves open goes on to a round of fewer tasks, and so on until one task is left, which closes
everything.  The tasks of a round are as many as hand each about ``GATHER`` times what it may keep open, so
the last one reads a bounded number of sequences, whatever the input.

Tokens: where the tokenizer file folds white space and no pre-token holds any (:func:`stretched` looks), the ids of a text
are those of its stretches between ASCII white space, one after the other.  Each distinct stretch is then encoded by the
library once, up to a bound, a Latin word with marks after it as the word in lower case and the marks.  Other files have
every text encoded whole.  Texts are taken in spans of about ``ROOM`` characters.

Defined cases: null text is empty and is one piece that holds the end id; very long texts are cut into pieces of the
full length, the last one shorter; ties go to the sequence opened last; repeated rows and ids are rows like any other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, store

LENGTH = 4096
END = 1
OPEN = 512           # sequences a task keeps open
GATHER = 8           # tasks' open sequences that a task of the next round reads, about
CACHE = 1_000_000      # stretches of a generation whose ids a worker remembers
JOIN = 256           # stretches sent to the library in one text
ROOM = 1 << 20       # characters split at a time
ROWS = 1 << 14       # rows sent to Spark at a time
MARKS = ".,;:!?#$%&*()"  # of white space, letters, digits and apostrophes none
# fixed values of the tokenizer file
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FOLDS = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
BLANK = re.compile(r"[\x20\x09-\x0D]")


# ---- ids ----------------------------------------------------------------------------------------

def stretched(spec: dict) -> bool:
    """Whether a tokenizer file treats what lies between ASCII white space apart, and in it, runs of letters and runs of
    marks: its normalizer composes, folds white space and lowers case, its pre-tokenizer keeps the matches of ``PATTERN``."""
    norm, pre = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return ([(s["type"], s.get("pattern"), s.get("content")) for s in norm.get("normalizers") or []] == FOLDS
            and pre[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
            and [(p["type"], p["use_regex"], p["add_prefix_space"]) for p in pre[1:]] == [("ByteLevel", False, False)]
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(a["lstrip"] or a["rstrip"] or BLANK.search(a["content"]) for a in spec["added_tokens"]))


class Ids:
    """Ids of texts as the library gives them, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.splits = stretched(json.loads(self.library.to_str()))
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        # two generations of stretches and their ids
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> None:
        """Stretches that are one pre-token each, many in one text."""
        groups = [words[i:i + JOIN] for i in range(0, len(words), JOIN)]
        for group, ids in zip(groups, self.plain([b" ".join(g).decode() for g in groups]), strict=True):
            last = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            if len(last) != len(group) or last[-1] != len(data):
                raise ValueError("a word is not one pre-token")
            self.memory.update(zip(group, map(data.__getitem__, map(slice, [0, *last], last)), strict=False))

    def _learn(self, new: set[bytes]) -> None:
        words, rest = set(), []
        made, lows, ends = [], [], []  # not a list of tuples, which Python's garbage collector would visit
        for s in new:
            low, marks = (s.lower(), b"") if s.isalpha() else letters(s)
            if not low:
                rest.append(s)
                continue
            words.add(low)
            if marks:
                words.add(marks)
            if marks or low != s:
                made.append(s)
                lows.append(low)
                ends.append(marks)
        known = self.memory
        self._words(list(words.difference(known)))
        known[b""] = b""
        known.update(zip(made, map(add, map(known.get, lows), map(known.get, ends)), strict=True))
        known.update((s, i.tobytes()) for s, i in zip(rest, self.plain([s.decode() for s in rest]), strict=True))

    def know(self, stretches: set[bytes]):
        """A look-up that has all of ``stretches``; what was not asked for lately goes first."""
        if len(self.memory) > CACHE:
            self.older, self.memory = self.memory, {}
        new = stretches.difference(self.memory)
        again = new.intersection(self.older)
        self.memory.update((s, self.older[s]) for s in again)
        self._learn(new - again)
        return self.memory.__getitem__

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits or not texts:
            return [i.tobytes() for i in self.plain(texts)]
        parts = [t.encode().split() for t in texts]
        known = self.know(set().union(*parts))
        return [b"".join(map(known, p)) for p in parts]

    def spans(self, text: str):
        """The text in spans that can be encoded apart."""
        at = 0
        while self.splits and len(text) - at > ROOM:
            cut = BLANK.search(text, at + ROOM)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.end()
        yield text[at:]


def letters(stretch: bytes) -> tuple[bytes, bytes]:
    """A stretch as a word in lower case and a run of marks after it, each one pre-token; empty if it is anything else."""
    text = stretch.decode()
    core = text.rstrip(MARKS)
    low = core.lower()
    # letters up to here compose with nothing
    if low.isalpha() and max(low) < "\u0250":
        return low.encode(), text[len(core):].encode()
    return b"", b""


_OPEN: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The encoder of this worker process."""
    if path not in _OPEN:
        _OPEN[path] = Ids(path)
    return _OPEN[path]


def pieces(own: Ids, texts: list[str], length: int, end: int):
    """(number of the text, piece, start, length, crc32 of the ids) of every piece of the texts."""
    short = [k for k, t in enumerate(texts) if len(t) <= ROOM]
    done = dict(zip(short, own.encode([texts[k] for k in short]), strict=True))
    last = np.array([end], "<u4").tobytes()
    for k, text in enumerate(texts):
        at, held = 0, b""
        spans = iter([done[k]]) if k in done else (own.encode([s])[0] for s in own.spans(text))
        ended = False
        while not ended:
            more = next(spans, None)
            ended = more is None
            held += last if ended else more
            cut = len(held) if ended else len(held) - len(held) % (4 * length)
            for i in range(0, cut, 4 * length):
                part = held[i:min(i + 4 * length, cut)]
                yield k, at // length, at, len(part) // 4, zlib.crc32(part)
                at += len(part) // 4
            held = held[cut:]


# ---- bins ---------------------------------------------------------------------------------------

class Packer:
    """Bounded-space online best fit."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN):
        self.length, self.most = length, open_bins
        self.spaces = 0                       # bit f: some open bin has f places free
        self.by_space: dict[int, list] = {}   # open bins by free space, each a list of items
        self.n = 0

    def _put(self, free: int, items: list) -> None:
        self.by_space.setdefault(free, []).append(items)
        self.spaces |= 1 << free
        self.n += 1

    def _take(self, free: int) -> list:
        same = self.by_space[free]
        items = same.pop()
        if not same:
            self.spaces &= ~(1 << free)
            del self.by_space[free]
        self.n -= 1
        return items

    def add(self, size: int, item):
        """Packs an item and yields the bins that close."""
        fits = self.spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if self.n >= self.most:  # the fullest: the lowest bit
                yield self._take((self.spaces & -self.spaces).bit_length() - 1)
            free, items = self.length, []
        items.append(item)
        if free == size:
            yield items
        else:
            self._put(free - size, items)

    def rest(self):
        """The bins that are still open."""
        for same in self.by_space.values():
            yield from same


def _packed(items, length: int, open_bins: int, tag: int, names: list[str], kinds: list):
    """Batches of (doc_id, piece, start, length, ids_crc32, sequence_id, offset, open) from (size, row) pairs."""
    packer, out, seq = Packer(length, open_bins), [[] for _ in names], tag

    def emit(rows, still_open):
        nonlocal seq
        at = 0
        for row in rows:
            for c, v in zip(out, (*row, seq, at, still_open), strict=True):
                c.append(v)
            at += row[3]
        seq += 1

    def batch():
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        for c in out:
            c.clear()
        return b

    for size, row in items:
        for rows in packer.add(size, row):
            emit(rows, False)
        if len(out[0]) >= ROWS:
            yield batch()
    for rows in packer.rest():
        emit(rows, True)
        if len(out[0]) >= ROWS:
            yield batch()
    yield batch()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_bins: int = OPEN, end: int = END,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece.

    One pass over the texts without a shuffle, then rounds over what is left open: rows of seven numbers, of a
    bounded number of sequences a task.  Every round is a stored table, so a lost executor repeats tasks of one round.
    """
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    long, num = T.LongType(), T.IntegerType()
    schema = T.StructType([d.schema["doc_id"], T.StructField("piece", num), T.StructField("start", long),
                           T.StructField("length", long), T.StructField("ids_crc32", long),
                           T.StructField("sequence_id", long), T.StructField("offset", long),
                           T.StructField("open", T.BooleanType())])

    def kinds(batch):
        return [batch.schema.field("doc_id").type, pa.int32(), *[pa.int64()] * 5, pa.bool_()]

    def task(round_no: int, read):
        """One round: ``read`` makes (size, row) pairs of a batch."""
        def run(batches):
            from pyspark import TaskContext

            first = next(batches, None)
            if first is None:
                return
            tag = round_no << 56 | TaskContext.get().partitionId() << 32

            def items():
                yield from read(first)
                for b in batches:
                    yield from read(b)

            yield from _packed(items(), length, open_bins, tag, schema.names, kinds(first))
        return run

    def from_texts(b):
        own, names, texts = ids_of(tokenizer), b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for i in range(0, len(texts), 256):
            for k, piece, start, size, crc in pieces(own, texts[i:i + 256], length, end):
                yield size, (names[i + k], piece, start, size, crc)

    def from_rows(b):
        for row in zip(*[b.column(c).to_pylist() for c in schema.names[:5]], strict=True):
            yield row[3], row

    done = store(d.mapInArrow(task(0, from_texts), schema))
    out, round_no, last = [done.where("NOT open")], 0, False
    while not last:
        left = done.where("open")
        n = left.where(F.col("offset") == 0).count()
        if n == 0:
            break
        round_no += 1
        tasks = -(-n // (GATHER * open_bins))
        last = tasks == 1
        done = store(left.select(schema.names[:5]).repartition(tasks).mapInArrow(task(round_no, from_rows), schema))
        out.append(done if last else done.where("NOT open"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.drop("open")
