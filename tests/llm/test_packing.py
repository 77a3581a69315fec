import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ermine.llm import packing
from ermine.llm.queries import tokenizer

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(NAME))


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(library, rows, got, length):
    """Every piece is right, every sequence gapless and not too long."""
    want = {}
    for doc, text in rows:
        own = np.array(ids(library, text), "<u4")
        for p, at in enumerate(range(0, len(own), length)):
            part = own[at:at + length]
            want.setdefault((doc, p, at, len(part), zlib.crc32(part.tobytes())), []).append(1)
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert have == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def plain_best_fit(sizes, length, most):
    """The method told with lists: bins closed, in order, and bins left."""
    closed, bins = [], []
    for n in sizes:
        fits = [b for b in bins if length - sum(b) >= n]
        if fits:
            b = max(fits, key=lambda b: sum(b))
        else:
            if len(bins) >= most:
                full = max(bins, key=sum)
                bins = [x for x in bins if x is not full]
                closed.append(full)
            b = []
            bins.append(b)
        b.append(n)
        if sum(b) == length:
            bins = [x for x in bins if x is not b]
            closed.append(b)
    return closed, bins


def test_packer_is_bounded_space_best_fit():
    rng = random.Random(3)
    for most in (1, 2, 5):
        # different totals, so that no two open bins are equally full for long
        sizes = [rng.choice([1, 2, 3, 7, 11, 20, 31, 40]) for _ in range(300)]
        p, closed = packing.Packer(40, most), []
        for n in sizes:
            closed += [sorted(b) for b in p.add(n, n)]
        want, left = plain_best_fit(sizes, 40, most)
        assert sorted(map(sum, closed)) == sorted(map(sum, want))
        assert sorted(map(sum, p.rest())) == sorted(map(sum, left))
        assert p.n <= most


def test_ids_are_the_library_s(library):
    own = packing.Ids(tokenizer(NAME))
    assert own.splits
    texts = ["", " ", "a  b\tc\r\n", "It's NAÏVE, é ́x a b c\x1cd 12345 's 're", "x<|endoftext|>y <|startoftext|>",
             "<|endoftext| <|endoftext|> >", "ΣΑΣ ς İI ǅ", "日本語 テスト", "Word. word, WORD!? Éé. é. . ... İx. x.y ŉ K. Å, ßẞ ǅ. ab's. ª² ²",
             "Étion dans, çouelle", "T\u0308 H\u0331x t\u0308", "<|STARTOFTEXT|> <|startoftext|>. a, b.", '"a", (b. c), d', "a.", "é, É. x", "a\x0bb\x0cc\x85d e", "x" * 5000, "😀 👩‍👩‍👧 ͅ ﬁ"]
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_other_files_are_encoded_whole(library):
    spec = json.loads(library.to_str())
    assert packing.stretched(spec)
    for part, value in (("normalizer", None), ("pre_tokenizer", None), ("normalizer", {"type": "NFKC"})):
        assert not packing.stretched({**spec, part: value})
    pre = json.loads(json.dumps(spec["pre_tokenizer"]))
    pre["pretokenizers"][0]["pattern"]["Regex"] = r" ?\p{L}+|."
    assert not packing.stretched({**spec, "pre_tokenizer": pre})
    own = packing.Ids(tokenizer("byte_bpe_50k.json"))
    assert not own.splits
    assert np.frombuffer(own.encode(["a  b"])[0], "<u4").tolist() == own.library.encode("a  b").ids


def test_generations(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    own = packing.Ids(tokenizer(NAME))
    for k in range(12):
        texts = [f"Word{c}. the, {c} é{c} the" for c in "abcdefg"[k % 5:k % 5 + 3]]
        for t, got in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_pack(docs_of, clash, library):
    rng = random.Random(5)
    words = ["the", "Of,", "naïve", "x1y2", "日本", "antidis"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 200, 900])))) for k in range(120)]
    rows += [(200, None), (201, ""), (201, ""), (None, "null id"), (202, "the " * 3000), (7, rows[7][1]), (7, rows[7][1])]
    for most in (2, 512):
        got = packing.pack(clash(docs_of(rows)), tokenizer(NAME), length=256, open_bins=most).collect()
        n = check(library, rows, got, 256)
        tokens = sum(len(ids(library, t)) for _, t in rows)
        assert n <= 1.1 * -(-tokens // 256) if most > 2 else n <= 1.7 * -(-tokens // 256) + 2


def test_long_texts_in_spans(library, monkeypatch):
    monkeypatch.setattr(packing, "ROOM", 50)
    own = packing.Ids(tokenizer(NAME))
    text = "Some words, " * 40 + "y" * 200 + " end's"
    want = np.array(ids(library, text), "<u4")
    got = list(packing.pieces(own, [text, "short"], 16, packing.END))
    assert [g[2:] for g in got if g[0] == 0] == [(a, len(want[a:a + 16]), zlib.crc32(want[a:a + 16].tobytes()))
                                                 for a in range(0, len(want), 16)]
    assert len([g for g in got if g[0] == 1]) == 1


def test_empty(docs_of):
    assert packing.pack(docs_of([]), tokenizer(NAME)).collect() == []


def test_full_documents_close_alone(docs_of, library):
    rows = [(k, "the " * 7) for k in range(9)]
    got = packing.pack(docs_of(rows), tokenizer(NAME), length=8)
    assert got.agg(F.countDistinct("sequence_id")).first()[0] == 9
    check(library, rows, got.collect(), 8)
