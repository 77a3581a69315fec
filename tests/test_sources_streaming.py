"""Round trips through the sinks and readers; streaming assembly equals batch."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from ermine.operators import classify as C
from ermine.operators.assemble import assemble
from ermine.plans import fixtures as FX
from ermine.sources import models as S
from ermine.streaming import assembly as X2

SF = "/root/testdata/sf0.001"


def test_plantuml_round_trip(spark):
    c, a, r = FX.part_model(spark, SF)
    out = tempfile.mkdtemp(prefix="ermine-puml-", dir="/tmp")
    S.write_plantuml(S.plantuml_lines(c, a, r), out)
    rc, ra, rr = S.read_plantuml(spark, out)
    assert sorted(rc.select("model", "class_name").collect()) == sorted(c.select("model", "class_name").collect())
    assert sorted(ra.select("model", "class_name", "attr_name", "attr_type").collect()) == \
        sorted(a.select("model", "class_name", "attr_name", "attr_type").collect())
    assert sorted(rr.select("model", "src", "dst", "mult", "rel_name").collect()) == \
        sorted(r.select("model", "src", "dst", "mult", "rel_name").collect())


def test_plantuml_keeps_model_keys_empty_types_and_block_order(spark):
    c = spark.createDataFrame([("007", f"C{i}", i) for i in range(40)] + [("1e3", "X", 0)],
                              "model string, class_name string, first_ord long")
    a = spark.createDataFrame([(m, k, f"{t}{k}", ty, j) for m, k in [("007", f"C{i}") for i in range(40)] + [("1e3", "X")]
                               for j, (t, ty) in enumerate([("Title ", ""), ("size", None), ("of", "a : b"), ("n", "int")])],
                              "model string, class_name string, attr_name string, attr_type string, first_ord long")
    r = spark.createDataFrame([], "model string, src string, dst string, mult string, rel_name string, first_ord long")
    out = tempfile.mkdtemp(prefix="ermine-puml-", dir="/tmp")
    S.write_plantuml(S.plantuml_lines(c, a, r), out)
    settings = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():                                     # a file is read in many blocks
            spark.conf.set(k, v)
        rc, ra, _ = (x.collect() for x in S.read_plantuml(spark, out))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [x.class_name for x in sorted(rc, key=lambda x: x.class_pos) if x.model == "007"] == [f"C{i}" for i in range(40)]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((x.model, x.class_name, x.attr_name, x.attr_type) for x in ra), key=key) == sorted(
        ((x.model, x.class_name, x.attr_name, x.attr_type) for x in a.collect()), key=key)


def test_fragment_store_keeps_model_keys(spark):
    d = tempfile.mkdtemp(prefix="ermine-frag-", dir="/tmp")
    df = spark.createDataFrame([("007", 1), ("1e3", 2), (None, 3)], "model string, seq long")
    S.write_fragments(df, df, df, d)
    for t in S.read_fragments(spark, d):
        assert sorted(t.select("model", "seq").collect(), key=lambda x: x.seq) == df.collect()


def test_json_model_scan(spark):
    d = tempfile.mkdtemp(prefix="ermine-json-", dir="/tmp")
    wrapped = {"elements": [{"type": "package", "name": "p", "elements": [
        {"name": "Book", "members": [{"name": "title", "type": "String"}]},
        {"left": "Book", "right": "Author", "leftCardinality": "writes 1..*"},
        {"left": "Shelf", "right": "Book", "leftCardinality": "holds"},
        {"left": "Book", "right": "Page", "leftCardinality": "a b c"}]}]}
    bare = {"elements": [{"name": "Net", "members": []}, {"left": "Net", "right": "Place", "leftCardinality": ""}]}
    json.dump(wrapped, open(f"{d}/lib.json", "w"))
    json.dump(bare, open(f"{d}/petri_rel3.json", "w"))
    c, a, r, rej = S.read_json_models(spark, d)
    assert {(x.model, x.class_name) for x in c.collect()} == {
        ("lib", "Book"), ("lib", "Author"), ("lib", "Shelf"), ("petri", "Net"), ("petri", "Place")}  # rejected rows add none
    assert {(x.src, x.dst, x.mult, x.rel_name) for x in r.collect()} == {
        ("Book", "Author", "1..*", "writes"), ("Shelf", "Book", "", "holds"), ("Net", "Place", "", "")}
    assert rej.count() == 1
    assert a.collect()[0].attr_name == "title"


def _dir(name):
    return tempfile.mkdtemp(prefix=f"ermine-{name}-", dir="/tmp")


def _rows(df):
    return sorted(df.select(sorted(df.columns)).collect(), key=str)


def test_fragment_store(spark):
    frags = FX.part_fragments(spark, SF)
    d = _dir("frag")
    S.write_fragments(*frags, d)
    for got, want in zip(S.read_fragments(spark, d), frags, strict=True):
        assert _rows(got) == _rows(want)


def test_streaming_assembly_equals_batch(spark):
    frags = [x.withColumn("seq", F.col("seq.major") * 1000 + F.col("seq.minor")) for x in FX.part_fragments(spark, SF)]
    src, state, ck = _dir("src"), _dir("state"), _dir("ck")

    def arrive(part):
        for name, df in zip(X2.TABLES, frags, strict=True):
            df.filter(F.pmod(F.xxhash64("model", "seq"), F.lit(3)) == part).repartition(3).write.mode("append") \
                .parquet(f"{src}/{name}")
        X2.stream_assembly(spark, src, state, ck, max_files=2)

    for part in range(3):
        arrive(part)
    want = [_rows(x) for x in assemble(*frags)]
    assert [_rows(x) for x in X2.read_assembly(spark, state)] == want
    # a batch that runs again replaces itself
    batches = sorted(p for p in os.listdir(f"{state}/rels") if p.startswith("batch="))
    assert len(batches) >= 3
    number = int(batches[1].split("=")[1])
    again = spark.read.parquet(f"{state}/rels/{batches[1]}").collect()
    X2.write_batch(spark.createDataFrame(again, spark.read.parquet(f"{state}/rels/{batches[1]}").schema),
                   f"{state}/rels", number)
    assert [_rows(x) for x in X2.read_assembly(spark, state)] == want
    # compacted, and gone on with
    new = _dir("state")
    X2.compact(spark, state, new)
    more = spark.createDataFrame([("m", 1, "A", "B", "", "x"), ("m", 2, "A", "B", "1..1", "x")], X2.REL_SCHEMA)
    more.write.mode("append").parquet(f"{src}/rels")
    X2.stream_assembly(spark, src, new, ck)
    want = [_rows(x) for x in assemble(frags[0], frags[1], frags[2].unionByName(more))]
    assert [_rows(x) for x in X2.read_assembly(spark, new)] == want


def test_stream_classification_equals_batch(spark):
    docs = FX.labelled(spark, SF)
    train = C.term_counts(docs).join(docs.select("doc_id", "label"), "doc_id")
    model_dir, src, sink, ck = _dir("model"), _dir("text"), _dir("sink"), _dir("ck")
    model = C.bernoulli_fit(train, train_docs=docs)
    C.save_bernoulli(model, model_dir)
    asked = FX.corpus(spark, SF).select("doc_id", "text")
    for part in range(2):
        asked.filter(F.col("doc_id") % 2 == part).repartition(2).write.mode("append").parquet(src)
        X2.stream_classify(spark, src, model_dir, sink, ck, max_files=1)
    want = C.predict(C.bernoulli_score(*model, C.term_counts(asked), asked.select("doc_id")))
    rounded = lambda df: sorted((r.doc_id, r.prediction, round(r.score, 6)) for r in df.collect())
    assert rounded(X2.read_predictions(spark, sink)) == rounded(want)


def test_csv_and_reports(spark):
    d = _dir("csv")
    df = spark.createDataFrame([(1, 7, 'He said "no", twice'), (2, None, "two\nlines")], S.LABELS_SCHEMA)
    S.write_table(df, f"{d}/labels", "csv")
    assert _rows(S.read_csv(spark, f"{d}/labels", S.LABELS_SCHEMA)) == _rows(df)
    S.write_table(df, f"{d}/report", "json")
    assert _rows(spark.read.schema(S.LABELS_SCHEMA).json(f"{d}/report")) == _rows(df)


def test_json_names_of_any_script(spark):
    d = _dir("json")
    json.dump({"elements": [{"name": "A", "members": []}, {"left": "A", "right": "B", "leftCardinality": "gehört"},
                            {"left": "A", "right": "C", "leftCardinality": "0..*"}]}, open(f"{d}/m.json", "w"))
    c, _, r, _ = S.read_json_models(spark, d)
    assert {(x.dst, x.rel_name, x.mult) for x in r.collect()} == {("B", "gehört", ""), ("C", "", "0..*")}
    assert [x.class_name for x in sorted(c.collect(), key=lambda x: x.class_pos)] == ["A", "B", "C"]
