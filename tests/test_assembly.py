"""Assembly and scoring on literal fragments (fixed mode)."""
from ermine.operators.assemble import assemble
from ermine.operators import evaluate as E


def _frags(spark, classes, attrs, rels):
    fc = spark.createDataFrame(classes, "model string, seq long, class_pos int, class_name string, kind string")
    fa = spark.createDataFrame(attrs, "model string, seq long, class_name string, attr_pos int, attr_name string, "
                                      "attr_type string")
    fr = spark.createDataFrame(rels, "model string, seq long, src string, dst string, mult string, rel_name string")
    return fc, fa, fr


def test_merge_promote_link(spark):
    fc, fa, fr = _frags(
        spark,
        [("m", 1, 0, "Book", "class"), ("m", 2, 0, "BOOK", "class"), ("m", 3, 0, "Author", "class"),
         ("m", 0, 0, "Shelf", "class")],
        [("m", 1, "Book", 0, "title", None), ("m", 2, "BOOK", 0, "title", "string"),
         ("m", 0, "Shelf", 0, "book", None)],
        [("m", 5, "Author", "Book", "", "write"), ("m", 6, "Author", "Book", "1..*", "write"),
         ("m", 7, "Library", "Shelf", "", "")])
    c, a, r = assemble(fc, fa, fr)
    classes = sorted(x.class_name for x in c.collect())
    assert classes == ["Author", "Book", "Library", "Shelf"]          # A4 first spelling, A7 new endpoint
    attrs = {(x.class_name, x.attr_name): x.attr_type for x in a.collect()}
    assert attrs == {("Book", "title"): "string"}                      # A5 first non-null type; A6 removed
    rels = {(x.src, x.dst, x.rel_name): x.mult for x in r.collect()}
    assert rels[("Author", "Book", "write")] == "1..*"                 # A10 first non-empty multiplicity
    assert rels[("Shelf", "Book", "book")] == ""                       # A6 promotion, class came later
    assert ("Library", "Shelf", "") in rels
    assert E.integrity_violations(c, r).count() == 0                   # E10


def test_first_type_wins_beyond_many_attributes(spark):
    many = [("m", 1, "Book", i, f"a{i}", None) for i in range(40) if i != 20]
    fc, fa, fr = _frags(spark, [("m", 1, 0, "Book", "class"), ("m", 2, 0, "BOOK", "class")],
                        [*many, ("m", 1, "Book", 20, "x", "int"), ("m", 2, "BOOK", 0, "x", "string")], [])
    attrs = {x.attr_name: x.attr_type for x in assemble(fc, fa, fr)[1].collect()}
    assert len(attrs) == 40 and attrs["x"] == "int"                   # A5: fragment 1 comes first


def test_scores(spark):
    fc, fa, fr = _frags(spark, [("m", 1, 0, "A", "class"), ("m", 2, 0, "B", "class")], [],
                        [("m", 3, "A", "B", "", "x")])
    tc, _, tr = assemble(fc, fa, fr)
    pc, _, pr = assemble(fc.filter("seq = 1"), fa, fr.filter("seq = 0"))
    s = E.class_scores(pc, tc).first()
    assert (s.precision, s.recall) == (1.0, 0.5)
    r = E.relation_scores(pc, pr, tc, tr).first()
    assert (r.precision, r.recall) == (0.0, 0.0)
    z = E.size_similarity(tc, tr, tc, tr).first()
    assert abs(z.size_similarity - 1.0) < 1e-12
