import math
import random
from collections import Counter

import xxhash
from pyspark.sql import types as T

from ermine.llm import quality as Q

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType())])


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def slow_base(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    rep = len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep,
            len(w) < 10 or 100 * rep > 20 * len(w))


def bucket(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return (h - (h >> 63 << 64)) % Q.BUCKETS


def grams(t):
    w = words(t)
    return [bucket(x) for x in w] + [bucket(*p) for p in zip(w, w[1:], strict=False)]


def slow_ratio(rows, good):
    raw, tgt = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in good:
            tgt.update(grams(t))
    r, n = raw.total(), tgt.total()
    p = lambda b: (raw[b] + 1) / (r + Q.BUCKETS)
    f = lambda b: math.log((tgt[b] + Q.BUCKETS * p(b)) / (n + Q.BUCKETS) / p(b))
    return [(d, sum(map(f, grams(t))) / len(grams(t)) if grams(t) else 0.0) for d, t in rows]


def corpus(seed=0, n=200):
    r = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(200)] + ["a#b", "$$$", "|"]
    out = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 120))]
        if r.random() < 0.4 and len(w) > 20:
            w += w[r.randrange(10):r.randrange(10, 20)] * r.randrange(1, 4)
        text = ""
        for x in w:
            text += x + r.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0"])
        out.append((i, text + r.choice(["", "\nsame line\nsame line", "\n \n\n"])))
    return out + [(500, None), (501, ""), (502, " \n\x0c"), (503, "one"), (None, "no id " * 8), (3, "repeated id"),
                  (504, "a b c d e " * 20000), (505, "x \U0001F600y " * 4), (506, "w " * 9), (507, "v " * 10)]


def test_matches_brute_force(spark, docs_of, clash):
    rows = corpus()
    labels = [(i, int(i % 3 > 0), 0) for i in range(150)] + [(1, 1, 0), (None, 1, 0), (9999, 1, 0), (500, None, 0)]
    got = Q.quality(clash(docs_of(rows)), spark.createDataFrame(labels, LABELS)).collect()
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    want = sorted(((d, *slow_base(t), v) for (d, t), (_, v) in zip(rows, slow_ratio(rows, good), strict=True)), key=str)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                    r.ratio) for r in got), key=str)
    assert [x[:-1] for x in have] == [x[:-1] for x in want]
    assert all(math.isclose(a[-1], b[-1], abs_tol=1e-9) for a, b in zip(have, want, strict=True))
    assert all(r.kept == (not r.base_failed and r.ratio >= Q.THRESHOLD) for r in got)


def test_rejects_foreign_words_and_bounds_the_target(spark, docs_of):
    r = random.Random(1)
    word = lambda k: f"{k}{r.randrange(40)}"
    rows = [(i, " ".join(word("junk" if i % 10 == 0 else "good") for _ in range(100))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 300, 2)], LABELS)
    got = Q.quality(docs_of(rows), labels).collect()
    assert all(x.kept == (x.doc_id % 10 > 0) for x in got)
    assert Q.trusted_ids(labels.select("doc_id", "quality"), 7).count() == 7


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert Q.quality(docs_of([]), none).count() == 0
    assert [r.ratio for r in Q.quality(docs_of([(1, "a b c")]), none).collect()] == [0.0]
