"""Pronouns replaced by the most specific mention of their chain."""
from ermine.operators import corpus as P

MENTION = ("doc_id string, chain_id int, mention_id int, sent_id int, root_index int, token_indexes array<int>, "
           "is_most_specific boolean")


def _tokens(spark, *sentences):
    return spark.createDataFrame([("d", s, k, w) for s, x in enumerate(sentences) for k, w in enumerate(x.split())],
                                 "doc_id string, sent_id int, tok_id int, text string")


def _sentences(df):
    return [r.sentence for r in df.orderBy("sent_id").collect()]


def test_several_antecedents_are_joined_and_other_pronouns_stay(spark):
    toks = _tokens(spark, "Car , Bike and Boat move .", "The owner sells them with its key .", "It is red , it rolls .")
    m = spark.createDataFrame([("d", 1, 1, 0, 0, [0, 2, 4], True), ("d", 1, 2, 1, 3, [3], False),
                               ("d", 2, 1, 1, 1, [1], True), ("d", 2, 2, 1, 5, [5], False), ("d", 2, 3, 2, 0, [0], False),
                               ("d", 2, 4, 2, 4, [4], False)], MENTION)
    assert _sentences(P.resolved_sentences(toks, m)) == [
        "Car , Bike and Boat move .", "The owner sells Car,Bike and Boat with its key .", "It is red , owner rolls ."]


def test_without_mentions_nothing_changes(spark):
    toks = _tokens(spark, "It sees them .", "it")
    assert _sentences(P.resolved_sentences(toks, spark.createDataFrame([], MENTION))) == ["It sees them .", "it"]


def test_heuristic_mentions(spark):
    rows = [("d", 0, 0, "it", "PRON", None), ("d", 0, 1, "car", "NOUN", 1), ("d", 1, 0, "them", "PRON", None),
            ("d", 1, 1, "it", "PRON", None), ("e", 0, 0, "it", "PRON", None)]
    toks = spark.createDataFrame(rows, "doc_id string, sent_id int, tok_id int, text string, pos string, chunk_root int")
    m = P.antecedent_mentions(toks)
    got = sorted((r.doc_id, r.sent_id, r.root_index, r.is_most_specific) for r in m.collect())
    assert got == [("d", 0, 1, True), ("d", 1, 0, False), ("d", 1, 1, False)]
    assert [r.sentence for r in P.resolved_sentences(toks, m).orderBy("doc_id", "sent_id").collect()] == [
        "it car", "car car", "it"]
