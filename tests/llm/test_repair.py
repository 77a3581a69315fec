import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import types as T

from ermine.llm import repair as R
from ermine.llm.queries import ORACLE, op12_conversation_repair
from ermine.plans.check import compare

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def slow(rows):
    """Counts, cost, audit and hash of (role, text) rows: one pass over whole audits and whole lines."""
    seen, faults = set(), []
    for r, t in rows:
        core = re.sub(r"[\x20\x09-\x0D]", "", t)
        faults.append("b" if not core else "d" if (r, t) in seen else "" if core[-1] in ".!?" else "t")
        seen.add((r, t))

    def put(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def inserts(ways):
        for _ in range(4):
            for s, (c, a, x) in list(ways.items()):
                put(ways, NEXT[s], (c + 3, a + "I", [*x, NAME[NEXT[s]] + ":"]))
        return ways

    ways = inserts({"": (0, "", [])})
    for (r, t), f in zip(rows, faults, strict=True):
        new = {}
        for s, (c, a, x) in ways.items():
            put(new, s, (c + 4, a + "D", x))
            if f not in ("b", "d"):
                more = 3 if f == "t" else 0
                put(new, NEXT[s], (c + 3 + more, a + "R", [*x, f"{NAME[NEXT[s]]}:{t}"]))
                if r[:1] and (r[:1] == NEXT[s] or (r[:1] == "s" and s == "")):
                    put(new, r[:1], (c + more, a + "K", [*x, f"{r}:{t}"]))
        ways = inserts(new)
    cost, audit, lines = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*[faults.count(f) for f in "bdt"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def contract(table):
    by, one = {}, lambda v: " " if v is None else v
    for c, t, r, x in table:
        own, kind = by.setdefault(c, []), zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        r, x = one(r), one(x)
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, own in by.items():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *slow([v[1:] for v in own])))
    return out


def some(rng, n):
    return [(rng.choice(["system", "user", "assistant", "user", "tool", "", " "]),
             rng.choice(["a.", "b", "", " \t", "c!", "d?\n", "e.f"])) for _ in range(n)]


def faulty(rows):
    seen, out = set(), []
    for r, t in rows:
        out.append((r[:1], R.fault(t, (r, t) in seen)))
        seen.add((r, t))
    return out


def test_search_finds_the_least_of_the_cheapest():
    rng = random.Random(1)
    for _ in range(1500):
        rows = some(rng, rng.randint(0, 9))
        assert R.search(faulty(rows), 0, R.ENDS) == slow(rows)[4:6], rows


def test_segments_chain_to_the_same():
    rng = random.Random(2)
    for _ in range(200):
        rows = faulty(some(rng, rng.randint(1, 30)))
        heads = {0: (0, "")}
        for at in range(0, len(rows), 4):
            links = [{"start": s, "end": e, "cost": w[0], "audit": w[1]} for s in R.STATES for e in R.STATES
                     if (w := R.search(rows[at:at + 4], s, (e,)))]
            heads = R.chain(heads, links)
        assert min(heads[s] for s in R.ENDS if s in heads) == R.search(rows, 0, R.ENDS)


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@pytest.mark.parametrize("segment", [3, 64])
def test_against_slow(spark, clash, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = [(c, t, *x) for c in range(60) for t, x in enumerate(some(rng, rng.randint(1, 9)))]
    rows += [(100, t, *x) for t, x in enumerate(some(rng, 300))]              # a long one
    rows += [(101, 5, "user", "same.")] * 40 + [(101, None, "user", "same.")]  # repeated rows
    rows += [(None, None, None, None), (None, 1, "user", "x."), (102, None, "assistant", "hm"), (103, 1, "user", None)]
    rows += [(104, t, "user", "long " * 5000 + ".") for t in range(4)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in R.repaired(clash(d)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(contract(rows), key=key)


def test_lines(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there."), (1, 2, "assistant", "yes."), (2, 0, "assistant", "")]
    facts, lines = R.repair(spark.createDataFrame(rows, SCHEMA))
    facts = {r.conv_id: r for r in facts.collect()}
    assert (facts[1].cost, facts[1].audit, facts[1].truncated, facts[1].illegal) == (4, "DKK", 1, 1)
    assert (facts[2].cost, facts[2].audit, facts[2].blank) == (4, "D", 1)
    text = {r.conv_id: r.lines for r in lines.collect() if r.lines}
    assert [tuple(x) for x in text[1]] == [("user", "there."), ("assistant", "yes.")] and 2 not in text


def test_empty(spark):
    assert R.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    r = compare(op12_conversation_repair(spark, sf), ORACLE["op12_conversation_repair"], sf)
    assert r["schema_match"] and r["values_match"], r
