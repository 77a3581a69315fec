import random
import zlib
from hashlib import sha256

import pytest

from ermine.llm import manifest as M
from ermine.llm.queries import op13_merkle_manifest
from ermine.plans.check import compare


def h(*x):
    return sha256("".join(x).encode()).hexdigest()


def text_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(x):
    out = [x]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def slow(rows):
    """The contract, told with lists; ``rows`` are dicts."""
    leaf = lambda r: h(*[text_of(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        by[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in by[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            proof = []
            for at, tree in ((i, trees[g]), (k, top)):
                for level in tree[:-1]:
                    proof.append((level[at ^ 1] if (at ^ 1) < len(level) else "", at & 1))
                    at >>= 1
            bad = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                bad["n_chars"] += 1
            x = leaf(bad)
            for s, left in proof:
                x = h(s, x) if left else h(x, s)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*[s for s, _ in proof]), x, x == top[-1][0]))
    return out


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_octopus_asks_for_the_fewest_nodes():
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 8, 13, 37):
        tree = levels([h(str(i)) for i in range(n)])
        for _ in range(20):
            own = sorted(rng.sample(range(n), rng.randint(1, n)))
            want = M.missing(own, n)
            nodes = {0: {i: tree[0][i] for i in own}}
            for lv, i in want:
                nodes.setdefault(lv, {})[i] = tree[lv][i]
            M.climb(nodes, 0, M.height(n), n)
            assert nodes[M.height(n)][0] == tree[-1][0]
            for i in own:  # and with each one left out, the root can't be derived
                assert M.fold(tree[0][i], M.path(nodes, i, n)) == tree[-1][0]
            for lost in want:
                short = {0: {i: tree[0][i] for i in own}}
                for lv, i in want:
                    if (lv, i) != lost:
                        short.setdefault(lv, {})[i] = tree[lv][i]
                M.climb(short, 0, M.height(n), n)
                assert 0 not in short.get(M.height(n), {}) or M.height(n) == 0


@pytest.mark.parametrize("levels_a_pass", [1, 2, 10])
def test_against_slow(docs_of, clash, monkeypatch, levels_a_pass):
    monkeypatch.setattr(M, "LEVELS", levels_a_pass)
    rows = [(k, f"text {k} é") for k in range(45)] + [(3, "other"), (3, "other"), (None, "no id"), (50, None), (51, "")]
    from pyspark.sql import functions as F
    d = docs_of(rows).withColumn("lang", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'de' WHEN doc_id % 7 = 1 THEN NULL "
                                                "WHEN doc_id = 2 THEN 'é' ELSE 'en' END"))
    d = d.withColumn("n_chars", F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars END"))
    same(M.documents_manifest(clash(d)).collect(), slow([r.asDict() for r in d.collect()]))


def test_one_row_and_none(docs_of):
    one = docs_of([(1, "a")])
    same(M.documents_manifest(one).collect(), slow([r.asDict() for r in one.collect()]))
    assert M.documents_manifest(docs_of([])).collect() == []


def test_many_groups(docs_of):
    from pyspark.sql import functions as F
    d = docs_of([(k, "x") for k in range(60)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    same(M.documents_manifest(d).collect(), slow([r.asDict() for r in d.collect()]))


def test_sql(spark):
    from ermine.llm.queries import ORACLE
    sf = "/root/testdata/sf0.001"
    r = compare(op13_merkle_manifest(spark, sf), ORACLE["op13_merkle_manifest"], sf)
    assert r["schema_match"] and r["values_match"], r
