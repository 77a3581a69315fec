import math
from collections import Counter

from ermine.llm import licenses as L

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.txt", "some prose without a notice\nand more of it"),
    (3, "a/b/c/LICENSE.md", "Licensed under the Apache License,\nVersion 2.0"),
    (4, "a/b/c/d/e.txt", "prose here"),
    (5, "a/y.txt", "long prose " * 20 + "\nThis work is licensed under the GNU General Public License, version 3."),
    (6, "q/z.txt", "nothing"),
    (7, None, "nothing"),
    (8, "a/n.txt", None),
    (9, "a/n.txt", None),
    (10, "top.txt", "prose"),
    (None, "r/L1", "Licensed under CC BY-NC 4.0."),
    (12, "r/L2", "Released under the MIT license"),
    (13, "r/s/t.txt", "the license of the work is under version and general terms " * 30),
]


def slow():
    """Plain cosines over all lines and templates, and a climb per file."""
    w = lambda t: L.words((t or "").encode())
    lines = [w(x) for _, _, t in FILES for x in (t or "").split("\n") if w(x)]
    df = Counter(x for line in lines for x in set(line))
    vocab = {x for _, t in L.TEMPLATES for x in w(t)}
    idf = lambda x: math.log((len(lines) + 1) / ((df[x] if x in vocab else 0) + 1)) + 1

    def best(a):
        out = []
        for name, t in L.TEMPLATES:
            x, y = Counter(a), Counter(w(t))
            dot = sum(x[k] * y[k] * idf(k) ** 2 for k in y)
            norm = math.prod(math.sqrt(sum((n * idf(k)) ** 2 for k, n in z.items())) for z in (x, y))
            out.append((-round(dot / norm, 12), name) if norm else (0, name))
        return min(out)

    own, files = {}, {}
    for k, (_, p, t) in enumerate(FILES):
        parts = [w(x) for x in (t or "").split("\n") if w(x)]
        hits = [(x, best(x)) for x in parts if best(x)[0] <= -L.SIMILARITY]
        whole = best(sum(parts, []))
        found = [b for _, b in hits] + ([whole] if whole[0] <= -L.SIMILARITY else [])
        if found:
            own[k] = min(found)[1]
            if p and (whole[0] <= -L.SIMILARITY or 2 * sum(len(x) for x, _ in hits) >= sum(map(len, parts))):
                files.setdefault(p.rpartition("/")[0], []).append(own[k])
    out = []
    for k, (d, p, _) in enumerate(FILES):
        name, where = own.get(k), "own" if k in own else None
        up = p.rpartition("/")[0] if p else None
        while name is None and up is not None:
            if up in files:
                n = Counter(files[up])
                name, where = min(n, key=lambda x: (-n[x], x)), "/" + up
            up = up.rpartition("/")[0] if up else None
        out.append((d, p, name, where))
    return sorted(out, key=str)


def test_matches_brute_force(spark, clash):
    df = clash(spark.createDataFrame(FILES, "doc_id long, path string, text string").repartition(3))
    got = sorted(((r.doc_id, r.path, r.license, r.found) for r in L.licenses(df).collect()), key=str)
    assert got == slow()
    by = {r[0]: r[2:] for r in got}
    assert by[2] == ("MIT", "/a") and by[4] == ("Apache-2.0", "/a/b/c") and by[5] == ("GPL-3.0", "own")
    assert by[6] == by[7] == by[10] == (None, None) and by[8] == ("MIT", "/a") and by[13] == ("CC-BY-NC-4.0", "/r")


def test_empty_table(spark):
    assert L.licenses(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0
