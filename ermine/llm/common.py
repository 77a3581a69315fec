"""Helpers shared by the operators: column picking, stored stages, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"  # a word: a run of anything but ASCII white space (bytes.split() agrees)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    One job; the result has no lineage, prunes columns, and survives lost executors.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/ermine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame, scan: bool = False) -> DataFrame:
    """(doc, file, at): each row of ``docs`` as a struct, and its place in a stored file, which tells equal rows apart.

    ``scan`` says that ``docs`` is a plain scan of stored files, which is then read where it lies; any other frame
    is stored first, since its rows may have no place, or share one.
    """
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if not scan:
        docs = store(docs.select(rows))
        rows = F.col("doc")
    place = docs.metadataColumn("_metadata")
    return docs.select(rows, place.getField("file_path").alias("file"), place.getField("row_index").alias("at"))


def remainder(c: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null for null."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % n


def held_out(c: str, n: int, at: int) -> Column:
    """True where the remainder is ``at``; a null id is never held out."""
    return F.coalesce(remainder(c, n) == at, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambda bodies would compute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a short text, bit by bit (it has no such function)."""
    data = f"hex(encode({text}))"
    bits = (f"flatten(list_transform(range(1, length({data}), 2), "
            f"lambda k: [CAST('0x' || substring({data}, k, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))")
    return (f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), "
            f"CAST(4294967295 AS BIGINT)), 4294967295)")
