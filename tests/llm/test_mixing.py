import math
import random
from collections import Counter, defaultdict

import pytest

from ermine.llm import mixing as M


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | t
        capped |= {s: 3.0 * sizes[s] for s in over}


def rows(seed=0, n=1500):
    r = random.Random(seed)
    src = ["hot"] * 60 + ["b", "a", "é", "Z", None, "\U0001F600", "￮"] * 3 + ["tiny"]
    out = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(src))
           for i in range(n)]
    return out + [(n, None, "b"), (n + 1, " \n", "only blank"), (None, "a b c", "b"), (n + 3, "same id", "a"),
                  (n + 3, "same id", "a"), (n + 2, "x " * 30000, "b")]


def test_targets_quotas_and_caps(docs_of, clash):
    data = rows()
    got = M.mix(clash(docs_of(data)), shard_rows=64).collect()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len((t or "").split())) for d, t, _ in data)
    taken, of = defaultdict(int), {}
    by_id = defaultdict(list)
    for d, t, s in data:
        by_id[d].append(s)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by_id[r.doc_id][0]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        taken[s] += r.taken
        of[s] = r.target
    for s in of:
        assert abs(taken[s] - of[s]) <= M.BLOCK, (s, taken[s], of[s])
    again = M.mix(docs_of(list(reversed(data)), 5), shard_rows=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("seats", [1, 7, 40, 1000])
def test_apportion_is_sainte_lague(spark, seats):
    r = random.Random(seats)
    w = [0, 1, 1, 1, 500] + [r.randrange(1, 300) for _ in range(30)]
    df = spark.createDataFrame([("g", i, float(x), seats) for i, x in enumerate(w)], "g string, i long, w double, h long")
    quotients = sorted(((-x / (2 * k + 1), i) for i, x in enumerate(w) if x for k in range(seats)))[:seats]
    want = Counter(i for _, i in quotients)
    got = {x.i: x.quota for x in M.apportion(df, ["g"], "w", "h", ["i"]).collect()}
    assert got == {i: want[i] for i in range(len(w))}


def test_mixed_rows_hold_what_the_plan_takes(docs_of, clash):
    data = rows(1, 300)
    df = clash(docs_of(data))
    out = M.mixed(df, shard_rows=64)
    assert out.columns == df.columns
    plan, words = Counter(), Counter()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    for r in out.collect():
        words[r.source] += len(r.text.split())
        assert len(r.text.split()) > 0
        assert any((t or "").startswith(r.text) for d, t, _ in data if d == r.doc_id)
    for s, t in slow_targets(sizes).items():
        assert abs(words[s] - t) <= M.BLOCK, (s, plan)


def test_mixed_scan_is_the_same_mix_in_any_layout(spark, docs_of, clash, tmp_path):
    data = rows(2, 300)
    want = None
    for parts in (1, 4):
        clash(docs_of(data, parts)).write.parquet(f"{tmp_path}/docs{parts}")
        df = spark.read.parquet(f"{tmp_path}/docs{parts}")
        for out in (M.mixed(df, scan=True, shard_rows=64), M.mixed(df, shard_rows=64)):
            got = sorted((str(r.doc_id), r.source, r.text) for r in out.collect())
            assert got and got == (want or got)
            want = got


def test_empty_and_wordless_tables(docs_of):
    assert M.mix(docs_of([])).count() == 0
    assert M.mixed(docs_of([])).count() == 0
    assert [(r.size, r.target, r.taken) for r in M.mix(docs_of([(1, ""), (2, None)])).collect()] == [(0, 0.0, 0)] * 2
    assert [r.taken for r in M.mix(docs_of([(1, "just three words " * 9)])).collect()] == [24]  # 3 blocks of 8
