import random
import zlib

from pyspark.sql import types as T

from ermine.llm import toxicity as X

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType())])


def corpus(n=900, seed=0):
    r = random.Random(seed)
    syllables = ["ta", "re", "mo", "li", "na", "su", "ke", "po"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["grobb", "Grobb,", "vex" + word()])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_columns(spark, docs_of, clash):
    rows, labels = corpus()
    extra = [(5000, None), (5001, ""), (5002, "grobb"), (None, "ta re mo"), (5003, "ta re " * 40000)]
    lab = [*labels, (5000, 1, None), (None, 1, 1), (1, 1, 7), (99999, 1, 1)]
    got = X.score(clash(docs_of(rows + extra)), spark.createDataFrame(lab, LABELS)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for d, r in by.items():
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
    test = [(by[d].predicted, t) for d, _, t in labels if by[d].held_out]
    assert len(test) > 100
    assert sum(p == t for p, t in test) / len(test) >= 0.97
    assert by[5000].predicted == by[5001].predicted == by[5003].predicted == 0 and by[5002].predicted == 1


def test_sample_is_bounded_and_repeatable(spark, docs_of):
    rows, labels = corpus(300)
    lab = spark.createDataFrame(labels, LABELS)
    ids = lambda parts: sorted((r.doc_id, r.toxic) for r in X.training_rows(
        docs_of(rows, parts).select("doc_id", "text"), lab.repartition(parts), 20).collect())
    assert len(ids(2)) == 40 and ids(2) == ids(5)
    assert all(zlib.crc32(str(d).encode()) % 4 != 2 for d, _ in ids(2))


def test_drop_toxic_keeps_columns(spark, docs_of, clash):
    rows, labels = corpus(400, 1)
    df = clash(docs_of(rows))
    lab = spark.createDataFrame(labels, LABELS)
    out = X.drop_toxic(df, lab)
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    wrong = [d for d, _, t in labels if (d in kept) == bool(t)]
    assert len(wrong) <= 0.03 * len(labels)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert X.score(docs_of([]), none).count() == 0
    assert [r.score for r in X.score(docs_of([(1, "grobb")]), none).collect()] == [0.0]


def test_conditional_probabilities_sum_to_one():
    m = X.KneserNey({"grobb": (5, 0), "tare": (3, 40), "mota": (2, 30), "gro": (1, 1)})
    chars = {g[-1] for g in m.top}
    assert abs(sum(m.shared("rob" + c) for c in chars) + m.shared("rob\x00") - 1) < 1e-9
