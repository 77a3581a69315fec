"""What is made of a text stays in its text's partition, and work grows with the text."""
import time

from pyspark.sql import functions as F

from ermine.functions.lexicon import lexicon_df
from ermine.operators import annotate as A
from ermine.operators import assemble as M
from ermine.operators import classify as C
from ermine.operators import corpus as P
from ermine.operators import evaluate as E
from ermine.operators import extract as X
from ermine.plans import fixtures as FX
from ermine.session import cut_lineage, cut_lineage_by, text_pieces

TEXTS = [(1, "A school has departments. A driver uses a car."), (2, "A bird with a head.\nIt has it."), (3, None),
         (2, "A net is part of the graph."), (None, "A wheel.")]


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _corpus(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _stored(spark):
    return cut_lineage_by(A.annotate(_corpus(spark), lexicon_df(spark, True), 3), "doc_id", 3)


def test_tokens_are_not_exchanged(spark):
    toks = A.annotate(_corpus(spark), lexicon_df(spark, True), 3)
    p = _plan(toks)
    assert p.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" in p
    stored = _stored(spark)
    for df in (A.chunk_names(stored), P.rebuild_sentences(stored), P.nearest_antecedents(stored)):
        assert "Exchange hashpartitioning" not in _plan(df)
    assert stored.exceptAll(toks).count() == 0 and toks.exceptAll(stored).count() == 0


def test_names_only_of_tokens_asked(spark):
    toks = _stored(spark).filter("doc_id = 1")
    whole = A.token_names(toks)
    asked = toks.filter("tok_id = chunk_root").select("doc_id", "sent_id", "tok_id")
    some = A.token_names(toks, asked=asked)
    assert 0 < some.count() < whole.count()
    want = {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in some.collect()} == want & {tuple(r) for r in some.collect()}
    assert {(r.rule, r.src, r.dst) for r in X.all_hits(toks, names=whole).collect()} \
        == {(r.rule, r.src, r.dst) for r in X.all_hits(toks).collect()}


def test_long_sentence_is_linear(spark):
    def seconds(n):
        text = "the big " * n + "dog , "
        t = time.time()
        out = A.annotate(_corpus(spark, [(1, text)]), lexicon_df(spark, True), 1).agg(
            F.count("chunk_root").alias("n"), F.max("chunk_root").alias("last")).first()
        assert (out.n, out.last) == (2 * n + 1, 2 * n)
        return time.time() - t
    seconds(100)
    short, long = seconds(2_000), seconds(40_000)
    assert long < 20 * max(short, 1.0)      # 20 times the tokens; 400 times the work before


def test_kinds_of_a_key_of_two(spark):
    docs = spark.createDataFrame([(1, 0, "ab cd ab", "x"), (1, 1, "cd ef", "y"), (2, 0, "ef", "y"), (2, 1, "", "x")],
                                 "doc_id long, sent_id int, t string, label string")
    key = ["doc_id", "sent_id"]
    tf = C.term_counts(docs, key, "t")
    assert {tuple(r) for r in tf.collect()} == {(1, 0, "ab", 2), (1, 0, "cd", 1), (1, 1, "cd", 1), (1, 1, "ef", 1), (2, 0, "ef", 1)}
    two = C.bernoulli_nb(tf.join(docs.select(*key, "label"), key), tf, train_docs=docs, test_docs=docs, key=key)
    one = docs.withColumn("doc_id", F.col("doc_id") * 10 + F.col("sent_id"))
    tf1 = C.term_counts(one, text="t")
    plain = C.bernoulli_nb(tf1.join(one.select("doc_id", "label"), "doc_id"), tf1, train_docs=one, test_docs=one)
    assert sorted((r.doc_id * 10 + r.sent_id, r.label, round(r.score, 9)) for r in two.collect()) \
        == sorted((r.doc_id, r.label, round(r.score, 9)) for r in plain.collect())


def test_pieces_grow_with_the_text(spark):
    few = text_pieces(_corpus(spark))
    big = spark.range(400).select("id", F.expr("repeat('a', 1 << 20)").alias("text"))
    assert few == spark.sparkContext.defaultParallelism and text_pieces(big) == max(few, 100)


def test_role_bits_are_those_of_the_conditions(spark):
    from ermine.operators.rules import _bits_of
    asked = [(1, ("have", "be"), ()), (2, (), ("be",)), (4, (), ()), (8, ("name",), ("name",))]
    rows = spark.createDataFrame([("have",), ("be",), ("name",), ("other",), (None,)], "lemma string")
    got = {r[0]: r[1] for r in rows.select("lemma", _bits_of("lemma", asked)).collect()}
    assert got == {"have": 7, "be": 5, "name": 6, "other": 6, None: 4}


def test_stored_stages_take_methods_that_the_jvm_compiles(spark):
    from ermine.session import compiled
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with compiled(spark):
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == before


def test_tokens_are_stored_packed(spark):
    toks = A.annotate(_corpus(spark), lexicon_df(spark, True), 3)
    packed = cut_lineage_by(A.packed(toks), "doc_id", 3)
    # most lemmas are the text in lower case, and stand there already
    assert packed.filter("lemma = lower(text)").count() == 0 and packed.filter("lemma is null").count() > 0
    assert all(f.endswith(".zstd.parquet") for f in packed.inputFiles())
    back = A.unpacked(packed)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in toks.schema]
    assert back.exceptAll(toks).count() == 0 and toks.exceptAll(back).count() == 0
    assert "Exchange hashpartitioning" not in _plan(P.rebuild_sentences(back))


def test_a_task_annotates_two_megabytes_of_text(spark, tmp_path):
    n = 2 * spark.sparkContext.defaultParallelism
    df = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 1 << 20).alias("text"), F.lit("s").alias("source"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert FX.doc_pieces(spark, str(tmp_path)) == n


def test_results_are_dealt_out_without_the_names_of_roles(spark):
    hits = X.all_hits(_stored(spark))
    below = hits._jdf.queryExecution().optimizedPlan().toString().split("max_by(")[1].split("\n")[0]
    assert "shown" in below and "names" not in below and hits.count() > 0


def _parts(spark, folder, copies=1):
    """Tables of their own: the parts of two brands, one name twice, and orders that go through them."""
    rows = [(k + 10 * c, f"tin cup {k % 5}", f"Brand#{1 + k % 2}", f"TYPE {k % 3}", k) for c in range(copies) for k in range(10)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int") \
        .write.parquet(f"{folder}/part.parquet")
    lines = [(o, (3 * o + 2 * n) % 10, 1, n, 1.0, "N") for o in range(6) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                                 "l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_merged_relations_are_made_once(spark, tmp_path):
    sf = _parts(spark, tmp_path)
    model = FX.part_model(spark, sf)
    for got, want in zip(model, M.assemble(*FX.part_fragments(spark, sf)), strict=True):
        assert got.columns == want.columns and got.count() > 0
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert not any("lineitem" in f for f in got.inputFiles())


def test_only_the_tables_asked_for_are_stored(spark, tmp_path, monkeypatch):
    sf, stored = _parts(spark, tmp_path), []
    monkeypatch.setattr(FX, "cut_lineage", lambda df: (stored.append(df.columns), cut_lineage(df))[1])
    (tc, ta), (pc, pa) = FX.sided_models(spark, sf, (0, 1)).values()
    assert "class_name" in tc.columns and "attr_name" in ta.columns and pc.count() > tc.count() > 0 and pa.count() > 0
    # three tables of fragments, merged classes and relations, and the two asked for
    assert len(stored) == 7
    FX.sided_models(spark, sf, (0, 2))
    assert len(stored) == 8


def test_hits_stay_with_their_documents(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, toks = spark.conf.get(name), _stored(spark)
    want = X.all_hits(toks).collect()
    spark.conf.set(name, "-1")      # as where neither side of a join is small
    try:
        hits = X.all_hits(toks, pieces=3)
        assert "Exchange hashpartitioning" not in _plan(hits)
        assert sorted(map(str, hits.collect())) == sorted(map(str, want)) != []
    finally:
        spark.conf.set(name, before)


def test_only_chunks_with_a_role_are_kept_for_names(spark):
    from ermine.operators.rules import role_tokens, RULES_BY_ID
    toks = _stored(spark).filter("doc_id = 1")
    kept = role_tokens(toks, [RULES_BY_ID["R14"]])
    assert 0 < kept.count() < toks.count() and kept.filter("text = 'school'").count() == 1
    assert role_tokens(toks, [RULES_BY_ID["R17"]]).count() == 0


def test_rules_store_no_tokens_of_their_own(spark, tmp_path):
    _corpus(spark).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    hits = FX.doc_hits(spark, sf)
    assert ("tokens", id(spark), sf) not in FX._CACHE
    assert sorted(map(str, hits.collect())) == sorted(map(str, X.all_hits(FX.doc_tokens(spark, sf)).collect())) != []


def test_rare_terms_are_scored_as_frequent_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(10) if (k * j) % 7 < 3), "xy"[k % 2]) for k in range(12)]
                                 + [(90, "w1 none", "x"), (91, "", "y")], "doc_id long, text string, label string")
    tf = C.term_counts(docs)
    train = tf.join(docs.select("doc_id", "label"), "doc_id").filter("doc_id < 80")

    def scores(pieces=None):
        df = C.bernoulli_nb(train, tf, train_docs=docs.filter("doc_id < 80"), test_docs=docs, pieces=pieces)
        return sorted((r.doc_id, r.label, round(r.score, 9)) for r in df.collect())
    want = scores()
    assert len(want) == 28
    monkeypatch.setattr(C, "OFTEN", 6)      # three terms for each of two classes
    assert scores() == want and scores(2) == want


def test_semantics_of_sentences_are_merged_without_a_broadcast(spark):
    best = X.select_best(X.all_hits(_stored(spark)))
    models = _corpus(spark).select("doc_id", F.lit("m").alias("model")).distinct()
    best, kinds = cut_lineage(best), best.select("doc_id", "sent_id", "kind")   # its file is far below the broadcast limit
    frags = X.fragments(best, models)
    same = E.semantic_comparison(frags, frags, ["model", "seq"])
    assert "BroadcastHashJoin" not in _plan(same) and same.filter("same").count() == best.filter("doc_id is not null").count() > 0
    assert "BroadcastHashJoin" not in _plan(X.dispatch(best, cut_lineage(kinds)))


def test_fragments_stay_with_their_documents(spark):
    best = cut_lineage_by(X.select_best(X.all_hits(_stored(spark), pieces=3)).repartition(3, "doc_id"), "doc_id", 3)
    models = cut_lineage_by(_corpus(spark).select("doc_id", F.lit("m").alias("model")).distinct().repartition(3, "doc_id"), "doc_id", 3)
    for t in X.fragments(best, models):
        p = _plan(t.select("*", "seq.doc_id", "seq.sent_id").groupBy("model", "doc_id", "sent_id").count())
        assert "SortMergeJoin" in p and "Exchange hashpartitioning" not in p
