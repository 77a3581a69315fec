"""Operator 7, licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of a file (a header) and the file as a whole (a licence file) is a vector of its words, weighted
by count times inverse document frequency over all lines of all files.  Words of no template get the weight of
a word never seen, which can only lower a similarity.  The best template at ``SIMILARITY`` or more names the
licence.  A file is a licence file of its directory where the file as a whole matches, or the lines that match make up
half of its words or more.  A file without a licence of its own takes that of the nearest directory above
it that has licence files: the licence most of them name, the first by name among equals.

Scale: two passes over the texts (frequencies of the few template words, then similarities) without
a shuffle of texts; the templates are a fixed table.  Directories resolve first, each once, by an equi-join of their
ancestors with the licensed ones; files then join their directory, a stored table, so that adaptive execution
splits a directory that holds a third of all files.

Defined cases: very long texts are scanned whole, line by line, one at a time in a task;
null text is empty and has no licence; null path is a file without a directory, which inherits
nothing; repeated paths and rows are files of their own; ties of similarity go to the template first by name;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, store

SIMILARITY = 0.7
# Usual notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
)
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation inside or around them."""
    return text.lower().translate(None, PUNCTUATION).split()


VOCABULARY = {w: i for i, w in enumerate(sorted({w for _, t in TEMPLATES for w in words(t.encode())}))}


class Matcher:
    """Similarity to the templates under given line frequencies of their words."""

    def __init__(self, lines: int, df: np.ndarray):
        idf = np.log((lines + 1) / (df + 1)) + 1
        self.idf = idf
        self.unseen = (math.log(lines + 1) + 1) ** 2
        rows = np.zeros((len(TEMPLATES), len(VOCABULARY)))
        for k, (_, t) in enumerate(TEMPLATES):
            for w, n in Counter(words(t.encode())).items():
                rows[k, VOCABULARY[w]] = n * idf[VOCABULARY[w]]
        self.rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        self.squares = self.rows ** 2

    def best(self, w: list[bytes], floor: float) -> tuple[float, str] | None:
        """(similarity, licence) of the best template at ``floor`` or more."""
        own = [VOCABULARY[x] for x in VOCABULARY.keys() & set(w)]
        # no similarity exceeds the length of the template's part that the words cover
        if not own or math.sqrt(self.squares[:, own].sum(axis=1).max()) < floor:
            return None
        vector, rest = np.zeros(len(VOCABULARY)), 0.0
        for x, n in Counter(w).items():
            if (i := VOCABULARY.get(x)) is None:
                rest += n * n * self.unseen
            else:
                vector[i] = n * self.idf[i]
        sims = self.rows @ vector / math.sqrt(float(vector @ vector) + rest)
        k = min(range(len(sims)), key=lambda i: (-round(float(sims[i]), 12), TEMPLATES[i][0]))
        return (float(sims[k]), TEMPLATES[k][0]) if sims[k] >= floor else None

    def scan(self, text: bytes | None, floor: float) -> tuple[str | None, float | None, bool]:
        """(licence, similarity, whether it is a licence file)."""
        every, found, matched, total = [], None, 0, 0
        for line in (text or b"").split(b"\n"):
            w = words(line)
            total += len(w)
            every += w
            if w and (hit := self.best(w, floor)):
                matched += len(w)
                if found is None or (-hit[0], hit[1]) < (-found[0], found[1]):
                    found = hit
        whole = self.best(every, floor) if every else None
        if whole and (found is None or whole[0] > found[0]):
            found = whole
        if found is None:
            return None, None, False
        return found[1], found[0], whole is not None or 2 * matched >= total


def frequencies(files: DataFrame) -> tuple[int, np.ndarray]:
    """Lines with a word, and in how many of them each template word is."""
    def run(batches):
        n, df = 0, Counter()
        for b in batches:
            for t in b.column(0):
                for line in (t.as_py() or b"").split(b"\n"):
                    if w := words(line):
                        n += 1
                        df.update(VOCABULARY.keys() & set(w))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(VOCABULARY[w] for w in df)], pa.int64()),
                                          pa.array([n, *df.values()], pa.int64())], names=["word", "n"])

    # as many rows as the templates have words, and one
    rows = files.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r["word"]: r["n"] for r in rows}
    return count.pop(-1, 0), np.array([count.get(i, 0) for i in range(len(VOCABULARY))], np.float64)


def licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
             floor: float = SIMILARITY) -> DataFrame:
    """(doc_id, path, license, similarity, found): ``found`` is ``own``, the directory it is inherited from, or null."""
    f = pick(files, doc_id=id_col, path=path_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    lines, df = frequencies(f)
    schema = T.StructType([*(x for x in f.schema.fields if x.name != "text"), T.StructField("own", T.StringType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("is_file", T.BooleanType())])

    def run(batches):
        matcher = Matcher(lines, df)
        for b in batches:
            own, sim, is_file = zip(*(matcher.scan(t.as_py(), floor) for t in b.column("text")), strict=True) \
                if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), pa.array(own, pa.string()),
                                              pa.array(sim, pa.float64()), pa.array(is_file, pa.bool_())],
                                             names=schema.names)

    folder = F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", ""))
    scanned = store(f.mapInArrow(run, schema).withColumn("dir", folder))
    # each directory's licence, then each directory's nearest licensed one above it (itself first)
    named = (scanned.where("is_file and dir is not null").groupBy("dir", "own").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("m"), "own"))["own"].alias("inherited")))
    dirs = scanned.select("dir").where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    climbed = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.*")
    nearest = (climbed.join(named.withColumnRenamed("dir", "up"), "up").groupBy("dir")
               .agg(F.max(F.struct("depth", "up", "inherited")).alias("x"))
               .select("dir", F.col("x.inherited").alias("inherited"), F.col("x.up").alias("from")))
    out = scanned.join(store(nearest), "dir", "left")
    has = F.col("own").isNotNull()
    return out.select("doc_id", "path", F.coalesce("own", "inherited").alias("license"), "similarity",
                      F.when(has, F.lit("own")).when(F.col("inherited").isNotNull(), F.concat(F.lit("/"), "from"))
                      .alias("found"))
