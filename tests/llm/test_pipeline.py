"""The pipeline over sf0.001: each stage's kept rows, as the next stage read them, against brute force."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import tokenizers

import corpus_pipeline as P
from ermine.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages_over_documents(spark, monkeypatch):
    read = {}

    def recording(name, stage):
        def run(spark, docs, sf_dir):
            read[name] = docs
            return stage(spark, docs, sf_dir)
        return name, run

    monkeypatch.setattr(P, "STAGES", [recording(*s) for s in P.STAGES])
    final = P.run(spark, SF).collect()
    rows = {name: df.collect() for name, df in read.items()}
    assert list(rows) == ["toxicity", "near_dedup", "decontamination", "mix", "records"]
    assert len({tuple(df.columns) for df in read.values()}) == 1          # the columns of documents
    docs = {r.doc_id: r for r in rows["toxicity"]}
    for name in ("near_dedup", "decontamination", "mix"):                 # a filter keeps rows as they are
        assert all(docs[r.doc_id] == r for r in rows[name])

    # labels mark under half of the documents: only those marked 0 are known to be clean.  With 11 toxic rows to
    # learn from, 4 of 76 clean ones go at this size (1 of 348 on sf0.01), so the bound is a loose one
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows["near_dedup"]}
    clean, toxic = ({i for i in docs if labels.get(i) == k} for k in (0, 1))
    assert len(kept & clean) >= 0.9 * len(clean) and len(kept & toxic) <= 0.5 * len(toxic)

    # near-dedup: the smallest id of each group of fingerprints within 4 bits, all pairs compared
    ids = sorted(kept)
    fps = [simhash.fingerprint((docs[i].text or "").encode()) for i in ids]
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in rows["decontamination"]) == [ids[a] for a in range(len(ids)) if find(a) == a]

    # the mix takes from the decontaminated rows only, none beyond 3 times its size
    words, taken = defaultdict(int), defaultdict(int)
    for r in rows["mix"]:
        words[r.doc_id] += len((r.text or "").encode().split())
    for r in rows["records"]:
        taken[r.doc_id] += len((r.text or "").encode().split())
    assert set(taken) <= set(words) and all(n <= 3 * words[i] for i, n in taken.items())

    # records: the library's ids of each text, the end id 0, one after the other
    tok = tokenizers.Tokenizer.from_file(P.tokenizer())
    want = Counter()
    for r in rows["records"]:
        t = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(t), zlib.crc32(np.array(t, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in final) == want
    final.sort(key=lambda r: r.start)
    assert [r.start for r in final] == [0, *np.cumsum([r.n_tokens for r in final])[:-1].tolist()]
    assert [r.doc_id for r in final] == sorted(r.doc_id for r in final)
