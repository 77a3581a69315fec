import random
from collections import Counter

from pyspark.sql import types as T

from ermine.llm import decontam as D

BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words_of(t):
    return (t or "").lower().encode().translate(None, D.PUNCTUATION).split()


def grams(w):
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(docs, items):
    """Every window of every document against every item."""
    out = {}
    for d, t in docs:
        w = words_of(t)
        for k, x in items:
            v = words_of(x)
            if not v:
                continue
            a, best = grams(v), 0
            for i in range(len(w) - len(v) + 1):
                b = grams(w[i:i + len(v)])
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[d, k] = best
    return out


def data(seed=0):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 60)))) for i in range(30)]
    items += [(30, "a a a a a a a a b"), (31, None), (32, " ., "), (33, "short one"), (34, items[3][1])]
    docs = []
    for i in range(150):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        if r.random() < 0.7:
            v = (r.choice(items)[1] or "").split()
            for _ in range(r.randrange(3)):
                if v:
                    k = r.randrange(len(v))
                    v[k:k + 1] = r.choice([[], ["new"], [v[k], "more"], [v[k].upper() + ","]])
            at = r.randrange(len(w) + 1)
            w[at:at] = v
        docs.append((i, " ".join(w)))
    return docs + [(500, None), (501, ""), (502, items[0][1] + " x" * 60000), (503, "A a, a a a a a a! b")], items


def test_matches_brute_force(spark, docs_of, clash):
    docs, items = data()
    bench = clash(spark.createDataFrame(items, BENCH))
    got = D.contamination(clash(docs_of(docs)), bench).collect()
    want = brute(docs, items)
    assert len(want) > 50
    assert len(got) == len(want)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert all(r.bits <= D.RADIUS for r in got)
    few = D.contamination(docs_of(docs), bench, block_words=100).collect()  # many blocks of items
    assert sorted(map(str, few)) == sorted(map(str, got))
    left = D.drop_contaminated(clash(docs_of(docs)), bench, block_words=300)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_repeats_nulls_and_empty_tables(spark, docs_of):
    item = "one two three four five six seven"
    bench = spark.createDataFrame([(None, item), (1, item), (1, item)], BENCH)
    got = D.contamination(docs_of([(None, item), (2, item), (2, item)]), bench).collect()
    assert len(got) == 9 and sum(r.item_id is None for r in got) == 3
    none = spark.createDataFrame([], BENCH)
    assert D.contamination(docs_of([(1, item)]), none).count() == 0
    assert D.drop_contaminated(docs_of([(1, item)]), none).count() == 1
    assert D.contamination(docs_of([]), bench).count() == 0
