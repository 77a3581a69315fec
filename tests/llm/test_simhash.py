import random

import numpy as np
import pytest
import xxhash

from ermine.llm import simhash as S


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f, least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def texts(n, seed=0):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split(" ")
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(["x", "Yes", "été"])
        else:
            w = [r.choice(["The", "cat", "über", "dog", "sat", "ran", "mat\n", "up"]) + str(r.randrange(50))
                 for _ in range(r.randrange(1, 200))]
        out.append(" ".join(w))
    return out


def result(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_links_are_all_pairs_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = base[rng.integers(0, 40, 300)]
    for _ in range(5):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) * rng.integers(0, 2, 300, dtype=np.uint64)
    ends = np.repeat([7, 8, 150, 300], [7, 1, 142, 150])
    got = {(int(a), int(b)) for i, j in S.links(fps, ends, radius) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, ends[i])
                   if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_matches_brute_force(docs_of, clash):
    rows = list(enumerate(texts(250))) + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (None, "one"),
                                          (5, "one"), (5, "one"), (904, "w " * 60000)]
    random.Random(1).shuffle(rows)
    assert result(S.near_duplicates(clash(docs_of(rows)))) == slow_components(rows)


def test_split_buckets_and_block_counts_change_nothing(spark):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(center[i % 4]) ^ sum({1 << int(b) for b in rng.integers(0, 64, 4)}) for i in range(500)}
    fps = sorted(f - (f >> 63 << 64) for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def comps(**k):
        return sorted((r.node, r.root) for r in S.components(S.near_links(df, 4, **k)).collect())
    want = comps()
    assert len(want) > 300
    assert comps(unit=16) == want and comps(blocks=5) == want and comps(blocks=8) == want


def test_empty_table(docs_of):
    assert S.near_duplicates(docs_of([])).count() == 0
    assert S.keep_first(docs_of([])).count() == 0


@pytest.mark.parametrize("scan", [False, True])
def test_keep_first_keeps_one_row_a_component(spark, docs_of, clash, tmp_path, scan):
    same = "a b c d e f g h"
    df = clash(docs_of([(3, same), (1, same), (1, same), (None, same), (7, "quite another text it is"), (None, "z"),
                        (None, "z")]))
    if scan:
        df.write.parquet(f"{tmp_path}/docs")
        df = spark.read.parquet(f"{tmp_path}/docs")
    got = S.keep_first(df, scan=scan)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [
        ("1", same), ("7", "quite another text it is"), ("None", "z")]


def test_components_of_a_long_chain_and_a_hub(spark):
    n = 600
    order = list(range(n))
    random.Random(2).shuffle(order)
    chain = [(order[i], order[i + 1]) for i in range(n - 1)]
    hub = [(10_000, 10_001 + i) for i in range(n)] + [(10_000, 10_000)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert {got[i] for i in range(n)} == {0} and {got[10_001 + i] for i in range(n)} == {10_000}
