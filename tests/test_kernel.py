"""The annotation kernel: batches, repeated sentences, words that the lexicon has twice, and the roles met on the way."""
import pyarrow as pa
import pytest

from ermine.functions.lexicon import lexicon_df, lexicon_rows
from ermine.operators import annotate as A
from ermine.operators import extract as X
from ermine.operators import kernel as K
from ermine.operators.rules import RULES, role_tokens, sentence_roles

TEXTS = [(1, "A school has departments. A driver uses a car. There is at least one big wheel, a net and an İ."),
         (2, "A bird with a head, a wing and a tail. The class named Graph has it!\nA net is composed of nodes by them."),
         (3, None), (4, "?\n \nclass"), (None, "A wheel is part of a car."), (7, "Nodes associated with the net ha ed. " * 30)]


def _sents(spark, rows=TEXTS):
    return A.sentences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"))


def _batch(rows):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                                       "sent_id": pa.array([r[1] for r in rows], pa.int32()), "words": pa.array([r[2] for r in rows], pa.list_(pa.string()))})


def _rows(batches, lexicon=lexicon_rows(True)):
    return [tuple(r.values()) for b in K.tokens_of(lexicon)(iter(batches)) for r in b.to_pylist()]


def test_batches_do_not_cut_sentences():
    rows = [(1, 0, ["A", "school", "has"]), (1, 0, ["A", "big", "car"]), (1, 1, []), (None, 0, ["it"]), (None, 0, ["net", "is"]), (2, 0, ["at", "least"])]
    whole = _rows([_batch(rows)])
    assert whole == _rows([_batch([r]) for r in rows]) and len(whole) == 11
    # the sentence that comes twice is one: its tokens by place, one place the root
    assert [r[2] for r in whole[:6]] == [0, 0, 1, 1, 2, 2] and {r[2] for r in whole[:6] if r[6] == "ROOT"} == {2}
    assert whole[-2][5] == "ADV"


def test_words_that_are_forgotten_are_learnt_again(monkeypatch):
    batches = [_batch([(d, 0, ["A", f"w{d}", "has", "class", "."])]) for d in range(9)]
    want = _rows(batches)
    monkeypatch.setattr(K, "MOST_WORDS", 3)
    assert _rows(batches) == want and len(want) == 45


def test_a_word_with_two_entries_gives_two_tokens():
    got = _rows([_batch([(1, 0, ["a", "run"])])], [("run", "VERB", "run", False), ("run", "NOUN", "run", True)])
    assert [(r[3], r[5], r[8]) for r in got] == [("a", "NOUN", False), ("run", "VERB", False), ("run", "NOUN", True)]


@pytest.mark.parametrize("rules", [RULES, RULES[2:4], RULES[10:11]])
def test_roles_made_of_sentences_are_those_of_tokens(spark, rules):
    lex = lexicon_df(spark, True)
    toks = A.annotate_sentences(_sents(spark), lex)
    want, got = role_tokens(toks, rules), sentence_roles(_sents(spark), lex, rules)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, X.all_hits(None, rules, pieces=3, kept=got).collect())) == sorted(map(str, X.all_hits(toks, rules).collect()))


def test_roles_of_one_rule_store_only_what_plays_one(spark, tmp_path):
    from ermine.operators.rules import RULES_BY_ID
    from ermine.plans import fixtures as FX
    spark.createDataFrame([(d, t, "s") for d, t in TEXTS], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert FX.doc_rule_hits(spark, str(tmp_path), RULES_BY_ID["R3"]).count() >= 0
    assert ("tokens", id(spark), str(tmp_path)) not in FX._CACHE
