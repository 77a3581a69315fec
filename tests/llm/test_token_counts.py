import random

import pytest

from ermine.llm import records as R
from ermine.llm import token_counts as C
from tests.llm.test_records import PATH, library, odd_texts

pytest.importorskip("public_tokenizers")


def test_spliced_counts_are_the_librarys(monkeypatch):
    t, own, r = library(), R.Encoder(PATH), random.Random(3)
    texts = odd_texts()
    texts = ["".join(r.sample(texts, 20)) for _ in range(60)] + [" ".join(r.sample(texts, 20)) for _ in range(60)]
    texts += ["x" * 700, " " * 500, "ab" * 300 + " " + "c" * 400 + " d" * 100, "日本語" * 300, "\n \n" * 200,
              "word " * 300, "<|endoftext|>" * 60, ("w" * 45 + "<|endoftext|> ") * 30]
    splices = []
    splice = C._splice
    monkeypatch.setattr(C, "_splice", lambda *a: splices.append(splice(*a)) or splices[-1])
    for chunk, overlap in ((40, 6), (64, 30), (200, 20)):
        for x in texts:
            assert C.count_huge(own, x, chunk, overlap) == len(t.encode(x, add_special_tokens=False).ids), repr(x)
    assert sum(s is None for s in splices) > 50 and sum(s is not None for s in splices) > 500


def test_query_over_nulls_repeats_and_long_texts(docs_of, clash):
    t = library()
    long = " ".join(odd_texts()) * 4
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "é" * 5), (4, "a" * 100_000), (5, "w " * 1024), (6, "b")]
    got = C.token_counts(clash(docs_of(rows)), PATH, chunk=5000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def row(d, x):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        return d, len((x or "").encode()), n, n > 1024
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(row(*r)) for r in rows)
    assert C.token_counts(docs_of([]), PATH).count() == 0
