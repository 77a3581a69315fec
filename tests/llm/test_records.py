import random
import zlib

import numpy as np
import pytest

from ermine.llm import records as R

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(5)
    bits = ["the", " ", "  ", "\n", " \n", "\n ", "\t ", "don't", "été,", "12345", "!!", "<|endoftext|>", "\xa0", "\x85",
            "\x1c", "　", "日本", "\U0001F600", "a", "'s", "x<|endoftext|> y", "​", "é"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(800)] + [
        " ".join(r.choice(bits).strip() or "w" for _ in range(r.randrange(60))) for _ in range(400)]


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys_own():
    t = library()
    texts = odd_texts()
    got = R.Encoder(PATH).encode(texts)
    for x, ids in zip(texts, got, strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_memory_bound_changes_nothing(monkeypatch):
    texts = odd_texts()
    want = R.Encoder(PATH).encode(texts)
    monkeypatch.setattr(R, "CACHE", 50)
    e = R.Encoder(PATH)
    got = [x for s in R.batches_of(texts, 300) for x in e.encode(texts[s])]
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def expect(rows):
    t, at, out = library(), 0, []
    key = lambda r: (r[0] is not None, r[0] or 0)
    for d, x in sorted(rows, key=key):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip(docs_of, clash, tmp_path):
    rows = list(enumerate(odd_texts()[:300])) + [(1000, None), (1001, ""), (1002, "long word " * 20000), (None, "no id")]
    random.Random(0).shuffle(rows)
    got = R.encode_documents(clash(docs_of(rows)), PATH, str(tmp_path / "out"))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == expect(rows)


def test_repeated_rows_and_index(docs_of, tmp_path):
    rows = [(7, "same row here")] * 5 + [(7, "another")] + [(i, f"text {i}") for i in range(20)]
    folder = str(tmp_path / "out")
    manifest = R.write_records(docs_of(rows), PATH, folder)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in R.read_records(manifest, folder).collect())
    want = expect(rows)
    assert [(d, s) for d, s, *_ in got if d != 7] == [(d, s) for d, s, *_ in want if d != 7]
    assert sorted(c for d, _, _, c in got if d == 7) == sorted(c for d, _, _, c in want if d == 7)
    t = library()
    for m in manifest.collect():
        for k in random.Random(0).sample(range(len(m.ids)), len(m.ids)):
            ids = R.read_record(folder, m.name, k).tolist()
            assert ids[-1] == 0 and t.decode(ids[:-1]) in {x for d, x in rows if d == m.ids[k]}


def test_damage_is_found(docs_of, tmp_path):
    folder = tmp_path / "out"
    m = R.write_records(docs_of([(1, "some text"), (2, "more text")], 1), PATH, str(folder)).first()
    f = folder / f"{m.name}.rec"
    data = bytearray(f.read_bytes())
    data[20] ^= 1
    f.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(R.read_frames(str(folder), m.name))


def test_empty_table(docs_of, tmp_path):
    assert R.encode_documents(docs_of([]), PATH, str(tmp_path / "out")).count() == 0
