import random

from ermine.llm import line_dedup as L


def slow(rows):
    """Selected positions against the first place of their fingerprint, extended without a limit on steps of the rule."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    docs = {k: L.line_hashes(rows[k][1]) for k in order}
    first, gone = {}, {k: set() for k in order}
    for k in order:
        at, h, n = docs[k]
        for i, s, p in sorted(L.selected(h, n)):
            if (p, s) not in first:
                first[p, s] = (k, i)
                continue
            k0, i0 = first[p, s]
            h0 = docs[k0][1]
            a, b = i, i + s
            while a > max(0, i - L.WINDOW) and i0 - (i - a) > 0 and h[a - 1] == h0[i0 - (i - a) - 1]:
                a -= 1
            while b < min(len(h), i + s + L.WINDOW) and i0 + b - i < len(h0) and h[b] == h0[i0 + b - i]:
                b += 1
            gone[k].update(range(a, b))
    return {k: [docs[k][0][x] for x in sorted(gone[k])] for k in order}


def corpus(seed=0, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = lambda m=12: " ".join(r.choice(vocab) for _ in range(r.randrange(1, m)))
    passages = [[line() for _ in range(r.randrange(3, 8))] for _ in range(8)]
    long = [" ".join(r.choice(vocab) for _ in range(60)) for _ in range(3)]
    out = []
    for i in range(n):
        lines = [line() for _ in range(r.randrange(0, 10))]
        at = r.randrange(len(lines) + 1)
        if r.random() < 0.5:
            lines[at:at] = r.choice(passages)
        if r.random() < 0.3:
            lines.insert(at, "  " + r.choice(long).upper() + " ")
        if r.random() < 0.3:
            lines.insert(at, " ")
        out.append((i, "\n".join(lines)))
    return out, passages, long


def test_matches_brute_force_and_guarantee(docs_of, clash):
    rows, passages, long = corpus()
    rows += [(600, None), (601, ""), (602, "\n \n"), (None, rows[3][1]), (603, "x y\nz\n" * 3000), (604, "one line")]
    got = {r.doc_id: r for r in L.repeated_lines(clash(docs_of(rows))).collect()}
    want = slow(rows)
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        assert got[d].removed == want[k], (d, t)
        assert got[d].n_lines == len(L.line_hashes(t)[0]) and got[d].n_removed == len(want[k])
    # each guaranteed run stands in one document at most, each long line too
    text = {r.doc_id: r.text for r in L.dedup(clash(docs_of(rows))).collect()}
    norm = lambda t: "\n".join(" ".join(x.lower().split()) for x in (t or "").split("\n") if x.strip())
    for p in ["\n".join(p) for p in passages] + long:
        assert sum(p in norm(t) for t in text.values()) == 1
    # every line that went still stands somewhere
    kept = {x for t in text.values() for x in norm(t).split("\n")}
    assert all(x in kept for _, t in rows for x in norm(t).split("\n"))


def test_repeated_rows_columns_and_empty_table(docs_of, clash):
    t = "a b\nc d\ne f\ng h"
    df = clash(docs_of([(1, t), (1, t), (2, "other\nlines here"), (3, None)]))
    out = L.dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, str(r.text)) for r in out.collect()) == [(1, ""), (1, t), (2, "other\nlines here"), (3, "None")]
    assert L.repeated_lines(docs_of([])).count() == 0
