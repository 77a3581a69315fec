"""Operator 6, token ids as length-delimited binary records.

A shard file is a run of frames: u64 length, u32 masked checksum of the length, the payload,
u32 masked checksum of the payload (all little-endian).  A payload is one document: u64 number
of ids, u8 bytes an id (2 or 4), then the ids.  Beside each shard lies an index file of u64
offsets, one a frame and the end, so that a reader can fetch frames in any order
(:func:`read_record`).  A checksum is crc32, rotated right by 15 and shifted by a constant,
so that a checksum of data that holds checksums stays meaningful.

Documents are range-partitioned by id (equal ids by a hash of the text), encoded, and
written in ascending order; null ids come first.  A shard's name holds a random part of
the attempt that wrote it, and the manifest, a table that Spark commits, names the
shards of the attempts that won: a lost executor leaves a file that nothing refers to.

Encoding asks the library once for each distinct stretch of text: a space after a
character that is no white space always begins a new pre-token of a byte-level model, so
texts fall apart there without changing an id.

Defined cases: null text is empty and has only the end id; texts in which a white space comes
before a space are encoded whole; repeated ids and rows each get a record; an empty table
writes no shard; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .common import pick, store

END = 0
MASK = 0xA282EAD8        # fixed value of the record format
CACHE = 400_000          # stretches of a generation whose ids a worker remembers
JOIN = 256               # stretches sent to the library in one text
ROOM = 1 << 26           # bytes of a shard held before they are written
BEFORE = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]  # a white space and a space


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<QB", len(ids), width) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", payload)
    return np.frombuffer(payload, f"<u{width}", n, 9).astype("<u4")


class Encoder:
    """Ids of texts, as the tokenizer file's library gives them; remembers stretches of text, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        # stretches can be told apart only by a byte-level model without normaliser or added prefix
        self.splits = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                       and not pre.get("add_prefix_space") and not spec.get("normalizer")
                       and not any(a["lstrip"] or a["rstrip"] or " " in a["content"] for a in spec["added_tokens"]))
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose text begins with a space
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        # two generations of stretches without their space, and their ids as bytes
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of stretches that begin with a space and hold no other, many in one call."""
        groups = [new[i:i + JOIN] for i in range(0, len(new), JOIN)]
        texts = [" " + " ".join(g) for g in groups]
        for group, ids in zip(groups, self.plain(texts), strict=True):
            a = np.array(ids, "<u4")
            cuts = np.flatnonzero(self.opens[a])
            if len(cuts) == len(group) and cuts[0] == 0:
                data, at = a.tobytes(), [*(4 * cuts).tolist(), 4 * len(a)]
                self.memory.update(zip(group, map(data.__getitem__, map(slice, at, at[1:])), strict=True))
            else:
                for s, own in zip(group, self.plain([" " + s for s in group]), strict=True):
                    self.memory[s] = np.array(own, "<u4").tobytes()

    def _know(self, stretches: set[str]) -> dict[str, bytes]:
        """The memory, with all of ``stretches`` in it; what was not asked for lately goes first."""
        if len(self.memory) > CACHE:
            self.older, self.memory = self.memory, {}
        new = stretches.difference(self.memory)
        again = new.intersection(self.older)
        self.memory.update((s, self.older[s]) for s in again)
        self._learn(list(new - again))
        return self.memory

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        parts = {k: t.split(" ") for k, t in enumerate(texts) if self.splits and not unsplit(t)}
        whole = [k for k in range(len(texts)) if k not in parts]
        firsts = [p[0] for p in parts.values()]
        plain = [np.array(i, "<u4").tobytes() for i in self.plain([texts[k] for k in whole] + firsts)]
        for k, ids in zip(whole, plain, strict=False):
            out[k] = ids
        stretches: set[str] = set()
        for p in parts.values():
            stretches.update(p[1:])
        known = self._know(stretches).__getitem__
        for (k, p), first in zip(parts.items(), plain[len(whole):], strict=True):
            out[k] = first + b"".join(map(known, p[1:]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.encode_bytes(texts)]


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its memory lasts from task to task."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def unsplit(text: str) -> bool:
    """Whether some space of the text may not begin a pre-token."""
    return text.startswith(" ") or any(map(text.__contains__, BEFORE))


def batches_of(texts: list[str], room: int = 1 << 21):
    """Slices of about ``room`` characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= room:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def filesystem(uri: str):
    """(file system, path) of a folder in any store that Arrow reaches, or of a plain path."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Frames into one file and their offsets into another beside it."""

    def __init__(self, folder: str):
        self.name = uuid.uuid4().hex
        self.store, path = filesystem(folder)
        self.store.create_dir(path, recursive=True)
        self.base = f"{path}/{self.name}"
        self.file = self.store.open_output_stream(f"{self.base}.rec")
        self.offsets, self.at, self.held, self.room = [], 0, [], 0

    def add(self, payload: bytes) -> None:
        f = frame(payload)
        self.offsets.append(self.at)
        self.at += len(f)
        self.held.append(f)
        self.room += len(f)
        if self.room >= ROOM:
            self.flush()

    def flush(self) -> None:
        self.file.write(b"".join(self.held))
        self.held, self.room = [], 0

    def close(self) -> None:
        self.flush()
        self.file.close()
        with self.store.open_output_stream(f"{self.base}.idx") as f:
            f.write(np.array([*self.offsets, self.at], "<u8").tobytes())


def read_frames(folder: str, name: str):
    """Payloads of a shard in file order; every length and checksum is checked."""
    where, path = filesystem(folder)
    with where.open_input_stream(f"{path}/{name}.rec", buffer_size=1 << 20) as f:
        while head := f.read(12):
            yield _payload(head, f)


def _payload(head: bytes, f) -> bytes:
    n, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("damaged length")
    body = f.read(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


def read_record(folder: str, name: str, k: int) -> np.ndarray:
    """The ids of record ``k``, found through the index file."""
    where, path = filesystem(folder)
    with where.open_input_file(f"{path}/{name}.idx") as f:
        f.seek(8 * k)
        at, = struct.unpack("<Q", f.read(8))
    with where.open_input_file(f"{path}/{name}.rec") as f:
        f.seek(at)
        return unpack_ids(_payload(f.read(12), f))


def write_records(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Writes the shards and returns the stored manifest: ``part``, ``name``, ``ids`` (of the documents, in
    file order), ``n_tokens`` of the shard."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    tie = F.xxhash64("text")
    d = d.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("name", T.StringType()),
                           T.StructField("ids", T.ArrayType(d.schema["doc_id"].dataType)),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        ids_of = writer = None
        ids, total = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                ids_of, writer = encoder(tokenizer).encode, ShardWriter(folder)
            text = b.column("text").to_pylist()
            for s in batches_of(text):
                for e in ids_of(text[s]):
                    writer.add(pack_ids(np.append(e, np.uint32(END))))
                    total += len(e) + 1
            ids.append(b.column("doc_id"))
        if writer is not None:
            writer.close()
            own = pa.concat_arrays(ids)
            column = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([writer.name]), column, pa.array([total], pa.int64())],
                                             names=schema.names)

    return store(d.mapInArrow(run, schema))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the shards of the manifest."""
    # one row a shard: as many as write_records had partitions
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    # by number, so that the small rows of the manifest are not gathered into one task
    shards = manifest.withColumn("start", before).repartition(max(1, manifest.count()), "part")
    schema = T.StructType([T.StructField("doc_id", manifest.schema["ids"].dataType.elementType),
                           T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                start, n, crc = b.column("start")[k].as_py(), [], []
                for p in read_frames(folder, b.column("name")[k].as_py()):
                    ids = unpack_ids(p)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                n = np.array(n, np.int64)
                own = b.column("ids")[k].values
                yield pa.RecordBatch.from_arrays([own, pa.array(start + np.cumsum(n) - n), pa.array(n),
                                                  pa.array(crc, pa.int64())], names=schema.names)

    return shards.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Write the documents and read them back; ``folder`` is by default a new one in the shared folder."""
    folder = folder or f"{checkpoint_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    return read_records(write_records(docs, tokenizer, folder, id_col, text_col), folder)
