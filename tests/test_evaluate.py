"""Comparisons on literal models: order, types, odd sides."""
import pytest
from pyspark.sql import types as T

from ermine.functions.order import placed
from ermine.operators import evaluate as E
from ermine.operators.assemble import assemble, flat
from ermine.operators.rules import descendant_pairs


def model(spark, classes, attrs=(), rels=()):
    c = spark.createDataFrame(list(classes), "model string, class_name string, kind string, first_ord long")
    a = spark.createDataFrame(list(attrs), "model string, class_name string, attr_name string, attr_type string, first_ord long")
    r = spark.createDataFrame(list(rels), "model string, src string, dst string, mult string, rel_name string, first_ord long")
    return c, a, r


def test_signatures_tell_order_and_types(spark):
    classes = [("m", n, "class", i) for i, n in enumerate("ABC")]
    t = model(spark, classes, [("m", "A", "x", None, 0), ("m", "A", "y", "int", 1), ("m", "B", "x", "int", 0)])
    p = model(spark, classes, [("m", "A", "y", "int", 0), ("m", "A", "x", None, 1), ("m", "B", "x", "", 0)])
    score = lambda typed: E.signature_scores(*p[:2], *t[:2], typed).first().precision
    assert score(True) == pytest.approx(1 / 3)      # only C, which has none; null and empty types differ
    assert score(False) == pytest.approx(2 / 3)     # B too; A has them in another order


def test_structural_equality(spark):
    t = model(spark, [("same", "A", "class", 0), ("same", "B", "rel", 1), ("swap", "A", "class", 0), ("swap", "B", "class", 1),
                      ("more", "A", "class", 0), ("gone", "A", "class", 0), ("tail", "A", "class", 0), ("kind", "A", "class", 0)],
              [("same", "A", "x", None, 0), ("tail", "A", "x", None, 0)], [("same", "B", "A", "", "r", 0)])
    p = model(spark, [("same", "A", "class", 5), ("same", "B", "rel", 9), ("swap", "B", "class", 0), ("swap", "A", "class", 1),
                      ("more", "A", "class", 0), ("more", "B", "class", 1), ("tail", "A", "class", 0), ("kind", "A", "rel", 0)],
              [("same", "A", "x", None, 7), ("tail", "A", "x", None, 0), ("tail", "A", "y", None, 1)],
              [("same", "B", "A", "", "r", 0)])
    got = {r.model: (r.n_pred, r.n_true, r.equal) for r in E.structural_equality(p, t).collect()}
    assert got == {"same": (2, 2, True), "swap": (2, 2, False), "more": (2, 1, False), "gone": (0, 1, False),
                   "tail": (1, 1, True), "kind": (1, 1, False)}
    strict = {r.model: r.equal for r in E.structural_equality(p, t, strict=True).collect()}
    assert strict["same"] and not strict["tail"]
    report = {r.model: r.status for r in E.assembly_report(E.structural_equality(p, t)).collect()}
    assert report["same"] == "passed" and report["gone"] == "failed"


def test_semantic_comparison(spark):
    def side(classes, attrs=(), rels=()):
        return (spark.createDataFrame(list(classes), "f int, class_pos int, class_name string"),
                spark.createDataFrame(list(attrs), "f int, class_name string, attr_pos int, attr_name string"),
                spark.createDataFrame(list(rels), "f int, dst string, mult string, rel_name string"))

    t = side([(1, 0, "Book"), (2, 0, "A"), (2, 1, "B"), (3, 0, "A"), (4, 0, "A"), (5, 0, "A"), (6, 0, "A")],
             [(1, "Book", 0, "title")], [(2, "B", "", "r"), (3, "B", "", "r"), (3, "C", "", "r"), (4, "B", "", "r")])
    p = side([(1, 0, "BOOK"), (2, 0, "A"), (3, 0, "A"), (4, 0, "A"), (5, 0, "A"), (7, 0, "A")],
             [(1, "BOOK", 0, "title"), (5, "A", 0, "x")], [(2, "B", "", "r"), (2, "B", "", "r"), (3, "B", "", "r")])
    got = {r.f: r.same for r in E.semantic_comparison(p, t, ["f"]).collect()}
    # 2: all relations one and the same; 3: not every pair; 4: a side without relations; 5: other attributes
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}
    asked = spark.createDataFrame([(k, "class") for k in range(1, 8)], "f int, kind string")
    status = E.semantics_status(asked, E.semantic_comparison(p, t, ["f"]), ["f"])
    counts = {(r.kind, r.status): r.n for r in E.semantics_report(status).collect()}
    assert counts[("class", "passed")] == 3 and counts[("class", "wrong")] == 2 and counts[("class", "failed")] == 2
    assert counts[(None, None)] == 7


def test_pairing_and_scores_see_both_sides(spark):
    t, p = model(spark, [("a", "A", "class", 0)]), model(spark, [("b", "A", "class", 0)])
    assert {(r.model, r.n_pred, r.n_true) for r in E.pairing(p[0], t[0]).collect()} == {("a", 0, 1), ("b", 1, 0)}
    for s in (E.class_scores(p[0], t[0]), E.relation_scores(p[0], p[2], t[0], t[2])):
        assert {(r.model, r.precision, r.recall, r.f1) for r in s.collect()} == {("a", 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 0.0)}


def test_self_loop_counts_once(spark):
    c, _, r = model(spark, [("m", "A", "class", 0), ("m", "B", "class", 1)],
                    rels=[("m", "A", "A", "", "", 0), ("m", "A", "B", "", "", 1)])
    assert {(x.class_name, x.degree) for x in E.graph_degrees(c, r).collect()} == {("A", 2), ("B", 1)}


def test_string_keys_keep_their_order(spark):
    seq = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("sent_id", T.IntegerType())])
    fields = lambda *more: T.StructType([T.StructField("model", T.StringType()), T.StructField("seq", seq), *more])
    s, i = T.StringType(), T.IntegerType()
    fc = spark.createDataFrame([("m", ("doc-b", 0), 0, "BOOK", "class"), ("m", ("doc-a", 5), 0, "Book", "class")], fields(
        T.StructField("class_pos", i), T.StructField("class_name", s), T.StructField("kind", s)))
    fa = spark.createDataFrame([], fields(T.StructField("class_name", s), T.StructField("attr_pos", i),
                                          T.StructField("attr_name", s), T.StructField("attr_type", s)))
    fr = spark.createDataFrame([("m", ("doc-z", 2), "Book", "X", "1..1", ""), ("m", ("doc-c", 2), "Book", "X", "0..*", "")], fields(
        T.StructField("src", s), T.StructField("dst", s), T.StructField("mult", s), T.StructField("rel_name", s)))
    c, _, r = assemble(fc, fa, fr)
    assert [(x.class_name, x.first_doc_id, x.first_sent_id) for x in flat(c).orderBy("first_phase").collect()] == [
        ("Book", "doc-a", 5), ("X", "doc-c", 2)]
    assert r.first().mult == "0..*"


def test_places_in_groups(spark):
    df = spark.range(1000).selectExpr("IF(id % 5 = 0, NULL, id % 3) AS g", "id * 7 % 1000 AS o").repartition(6)
    by = {}
    for r in placed(df, "g", ["o"], "n").collect():
        by.setdefault(r.g, []).append((r.o, r.n))
    for rows in by.values():
        assert [n for _, n in sorted(rows)] == list(range(len(rows)))


def test_descendants_of_a_long_chain_and_a_round(spark):
    n = 5000
    chain = [(1, 0, k, k - 1 if k else None) for k in range(n)] + [(2, 0, k, (k + 1) % 3) for k in range(3)]
    t = spark.createDataFrame(chain, "doc_id long, sent_id int, tok_id int, head int")
    got = descendant_pairs(t, t.filter(f"doc_id = 1 AND tok_id = {n - 1} OR doc_id = 2 AND tok_id = 0"))
    pairs = {(r.doc_id, r.desc, r.anc) for r in got.collect()}
    assert pairs == {(1, n - 1, k) for k in range(n - 1)} | {(2, 0, 1), (2, 0, 2)}
