import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from ermine.llm import suffix_tree as S


def spell(t):
    return b" ".join((t or "").encode().lower().split()) + b"\n"


def slow_tree(train, least, evidence):
    """context (in reading order) -> next-byte counts, of the retained contexts."""
    nxt = defaultdict(Counter)
    for t in train:
        s = b"\n" * S.DEPTH + spell(t)
        for i in range(S.DEPTH, len(s)):
            for d in range(S.DEPTH + 1):
                nxt[s[i - d:i]][s[i]] += 1
    keep = {}
    for c, n in nxt.items():
        if not c:
            keep[c] = n
        elif n.total() >= least:
            up = nxt[c[1:]]
            kl = sum(x / n.total() * math.log(x / n.total() / (up[a] / up.total())) for a, x in n.items())
            if n.total() * kl >= evidence * len(n):
                keep[c] = n
    return keep


def slow_score(tree, t):
    def p(ctx, a):
        while ctx not in tree and ctx:
            ctx = ctx[1:]
        n = tree.get(ctx, Counter())
        low = p(ctx[1:], a) if ctx else 1 / 256
        return (n[a] + S.WEIGHT * len(n) * low) / (n.total() + S.WEIGHT * len(n)) if n else low
    s = b"\n" * S.DEPTH + spell(t)
    return sum(math.log10(p(s[i - S.DEPTH:i], s[i])) for i in range(S.DEPTH, len(s)))


def rows(seed=0, n=120):
    r = random.Random(seed)
    out = [(i, " ".join("".join(r.choice(["ta", "ré", "Mo", "li"]) for _ in range(r.randrange(1, 4)))
                        for _ in range(r.randrange(0, 40)))) for i in range(n)]
    return out + [(500, None), (501, ""), (502, " \n"), (None, "ta li ta"), (503, "ÿ unseen \U0001F600 bytes"), (4, "ta"),
                  (4, "ta"), (504, "mo ta " * 30000)]


def test_matches_brute_force(docs_of, clash):
    data, least, evidence = rows(), 30, 2.0
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [t for d, t in data if not held(d)]
    tree = slow_tree(train, least, evidence)
    assert 20 < len(tree) < 2000
    count = Counter(w for t in train for w in [*(t or "").encode().lower().split(), b""])
    n, v = count.total(), len(count)
    got = S.score(clash(docs_of(data)), least=least, evidence=evidence, common=0.02).collect()
    want = []
    for d, t in data:
        w = [*(t or "").encode().lower().split(), b""]
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n,
                     sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), slow_score(tree, t)))
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-5), (a, b)


def test_pieces_passes_stretches_and_flushes_change_nothing(docs_of, monkeypatch):
    data = rows(2, 60)
    run = lambda: sorted((str(r.doc_id), round(r.score, 3), round(r.base_score, 6))
                         for r in S.score(docs_of(data)).collect())
    want = run()
    for name, small in (("PIECE", 60), ("PER_PASS", 3), ("STREAM", 5000), ("FLUSH", 300)):
        monkeypatch.setattr(S, name, small)
    tree = S.retained(S.gram_counts(docs_of(data).selectExpr("cast(text as binary)")))
    held = [(sum(len(p.value[0]) for p in parts), mine) for parts, mine in S.passes(tree.sparkSession, tree)]
    assert len(held) > 2 and max(n for n, _ in held) < tree.count() and (sum(m.astype(int) for _, m in held) == 1).all()
    assert run() == want


def test_contexts_kept_grow_with_the_input(docs_of):
    def kept(n):
        r = random.Random(1)
        texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(n)]
        t = S.retained(S.gram_counts(docs_of([(i, x * 2) for i, x in enumerate(texts)]).selectExpr("cast(text as binary)")))
        return t.selectExpr("d", "key & (shiftleft(1L, 8 * d) - 1) as ctx").distinct().count()
    few, many = kept(40), kept(400)
    assert many > 5 * few


def test_empty_table_and_no_training_rows(docs_of):
    assert S.score(docs_of([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = S.score(docs_of([(only, "ab c")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0.0
    assert math.isclose(r.score, 5 * math.log10(1 / 256), rel_tol=1e-5)
