"""Operator 12, repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of rows read and what the repaired roles end with so far: nothing (0), a system turn (1), a
user turn (2) or an assistant turn (3).  Keep, Rerole and Delete read a row, Insert reads none.  For the ends of a
segment two searches run towards each other, one heap forward from the start, one in reverse from the end; what both have
reached gives a bound, and the searches go on until no crossing of that cost can be left.  Of all crossings of the
least cost the one whose joined audit is ASCII-least wins.  That each side's least audit suffices: two audits over
the same rows cost the same only if they hold as many inserts, and then neither is the beginning of the other.

Scale: rows are range-partitioned by (conversation, turn, role, text) and cut into segments of bounded rows and
characters, within a conversation; so one that holds most rows is searched by many tasks.  A conversation that lies
inside a partition as one segment, nearly every one, is done there.  Of the others each segment gives its best audits
between each pair of ends; streams chain them in order, holding one audit a state, and write the repaired lines a
segment at a time.  The first row of a (role, text) is a minimum by group, found again by the number of the row, so no key
of the text is ever gathered.  Only the sha256 of a long conversation is one stream: it can be taken from the beginning only.

Defined cases: null id, turn, role and text count as one space where text is made of them; null turns come first;
rows of one turn are in the order of role and text after damage; repeated rows are duplicates; an empty role, or one that
begins with another character than s, u or a, can't be kept; a null id is a conversation and comes back as null; very long
texts fill segments of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, pick, store

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3   # costs; CUT: a truncated row that stays
SEGMENT = 64            # rows
ROOM = 1 << 20          # characters
STATES = range(4)       # nothing, system, user, assistant
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}   # (state, initial) -> state
TURNS = {0: 2, 1: 2, 2: 3, 3: 2}                                            # the state after a turn that we name
ENDS = (0, 3)
NAMES = {2: "user", 3: "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LAST = re.compile(r"[^\x20\x09-\x0D]")


# ---- one segment --------------------------------------------------------------------------------

def edges(rows: list[tuple[str, int]], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, at, state) of every edit at a node; a row is (initial of its role, fault)."""
    yield "I", INSERT, at, TURNS[state]
    if at < len(rows):
        initial, fault = rows[at]
        yield "D", DELETE, at + 1, state
        if fault not in (BLANK, DUPLICATE):
            more = CUT if fault == TRUNCATED else 0
            yield "R", REROLE + more, at + 1, TURNS[state]
            if (state, initial) in KEEPS:
                yield "K", KEEP + more, at + 1, KEEPS[state, initial]


def search(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state ``start`` before the rows to one of ``ends`` after them."""
    n = len(rows)
    before: dict[tuple[int, int], list] = {}   # node -> the edges that lead to it
    for at in range(n + 1):
        for s in STATES:
            for letter, cost, a, b in edges(rows, at, s):
                before.setdefault((a, b), []).append((letter, cost, at, s))
    ahead, back = {(0, start): (0, "")}, {(n, s): (0, "") for s in ends}
    # of equal costs, nodes in the order of the rows: only Keep costs nothing, and it reads a row
    heap, peah = [(0, 0, start)], [(0, -n, s) for s in ends]
    done, enod = set(), set()
    best = None
    while heap and peah and (best is None or heap[0][0] + peah[0][0] <= best):
        if heap[0][0] <= peah[0][0]:
            cost, at, s = heappop(heap)
            if (at, s) in done:
                continue
            done.add((at, s))
            audit = ahead[at, s][1]
            for letter, more, a, b in edges(rows, at, s):
                new = cost + more, audit + letter
                if (a, b) not in ahead or new < ahead[a, b]:
                    ahead[a, b] = new
                    heappush(heap, (new[0], a, b))
        else:
            cost, at, s = heappop(peah)
            at = -at
            if (at, s) in enod:
                continue
            enod.add((at, s))
            audit = back[at, s][1]
            for letter, more, a, b in before.get((at, s), ()):
                new = cost + more, letter + audit
                if (a, b) not in back or new < back[a, b]:
                    back[a, b] = new
                    heappush(peah, (new[0], -a, b))
        if (at, s) in ahead and (at, s) in back:
            both = ahead[at, s][0] + back[at, s][0]
            best = both if best is None else min(best, both)
    if best is None:
        return None
    enod.update((n, s) for s in ends)   # their distance is known from the beginning
    audits = [ahead[x][1] + back[x][1] for x in done & enod if ahead[x][0] + back[x][0] == best]
    for x in done:  # a crossing may also lie on an edit between the two sides
        for letter, more, a, b in edges(rows, *x):
            if (a, b) in enod and ahead[x][0] + more + back[a, b][0] == best:
                audits.append(ahead[x][1] + letter + back[a, b][1])
    return best, min(audits)


def chain(heads: dict[int, tuple[int, str]], links: list[dict]) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) by state after one segment more."""
    out: dict[int, tuple[int, str]] = {}
    for x in links:
        if x["start"] in heads:
            cost, audit = heads[x["start"]]
            new = cost + x["cost"], audit + x["audit"]
            if x["end"] not in out or new < out[x["end"]]:
                out[x["end"]] = new
    return out


class Writer:
    """The repaired lines of rows as they come, by an audit over all of them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserts(self) -> list[dict]:
        lines = []
        while self.audit[self.at:self.at + 1] == "I":
            self.at, self.state = self.at + 1, TURNS[self.state]
            lines.append({"role": NAMES[self.state], "text": ""})
        return lines

    def row(self, role: str, text: str) -> list[dict]:
        lines, letter = self.inserts(), self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEPS[self.state, role[:1]]
            lines.append({"role": role, "text": text})
        elif letter == "R":
            self.state = TURNS[self.state]
            lines.append({"role": NAMES[self.state], "text": text})
        return lines


# ---- rows ---------------------------------------------------------------------------------------

def damaged(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows lost, emptied, cut, repeated and given to the user by the crc32 of their key."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    c = conv.select("conv_id", "turn", kind.alias("kind"),
                    F.when(kind == 4, "user").otherwise(role).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    return c.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(
        F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


def firsts(rows: DataFrame) -> DataFrame:
    """``rows`` stored, with ``_row``, a number, and ``first``, whether no row before has the same role and text."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()))
    place = F.struct(F.col("turn").isNotNull(), "turn", "_row")
    first = rows.groupBy("conv_id", said.alias("said")).agg(F.min(place).alias("at")).select(
        F.col("at._row").alias("_row"), F.lit(True).alias("first"))
    return rows.join(first, "_row", "left").withColumn("first", F.col("first").isNotNull())


LINK = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
LINES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
COUNTS = ("blank", "duplicate", "truncated", "illegal")
FACTS = ("low", "high", "turns", *COUNTS, "cost")


def _schema(id_type: T.StructField, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", id_type.dataType)] + [T.StructField(c, t) for c, t in more.items()])


def _facts(id_type: T.StructField, **more: T.DataType) -> T.StructType:
    return _schema(id_type, part=T.LongType(), k=T.LongType(), **{c: T.LongType() for c in FACTS},
                   audit=T.StringType(), **more)


def fault(text: str, seen: bool) -> int:
    last = next((c for c in reversed(text) if LAST.match(c)), None)
    if last is None:
        return BLANK
    return DUPLICATE if seen else FINE if last in ".!?" else TRUNCATED


class Segment:
    """Rows of one conversation that follow each other, and what is counted over them."""

    def __init__(self, part: int, conv, k: int, before: tuple | None):
        self.part, self.conv, self.k, self.before = part, conv, k, before
        self.rows, self.lines, self.room = [], [], 0
        self.low = self.high = None
        self.turns = 0
        self.illegal = 0

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            if turn != (self.before or (None,))[0]:
                self.turns += 1
            self.high = turn
        if self.before is not None and (self.before[1] + role[:1]) not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = turn, role[:1]
        self.rows.append((role[:1], fault(text, seen)))
        self.lines.append({"role": role, "text": text})
        self.room += len(text)

    def out(self, whole: bool) -> tuple:
        n = [sum(f == x for _, f in self.rows) for x in (BLANK, DUPLICATE, TRUNCATED)]
        cost, audit, links, lines = None, None, [], self.lines
        if whole:
            cost, audit = search(self.rows, 0, ENDS)
            writer = Writer(audit)
            lines = [y for x in lines for y in writer.row(**x)] + writer.inserts()
        else:
            for s in STATES:
                for e in STATES:
                    if found := search(self.rows, s, (e,)):
                        links.append({"start": s, "end": e, "cost": found[0], "audit": found[1]})
        return (self.conv, self.part, self.k, self.low, self.high, self.turns, *n, self.illegal, cost, audit, whole,
                self.rows[0][0], self.rows[-1][0], links, lines)


def _stream(df: DataFrame, schema: T.StructType, rows_of, size=None) -> DataFrame:
    """``rows_of(rows of a partition)`` yields output rows; batches are of bounded rows and, by ``size``, characters."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = df.columns

    def run(batches):
        kinds = to_arrow_schema(schema)

        def rows():
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in names], strict=True)

        def batch(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

        out, room = [], 0
        for row in rows_of(rows()):
            out.append(row)
            room += size(row) if size else 0
            if len(out) >= 1024 or room >= ROOM:
                yield batch(out)
                out, room = [], 0
        if out:
            yield batch(out)

    return df.mapInArrow(run, schema)


def _room(row: tuple) -> int:
    return sum(len(x["text"]) for x in row[-1])


def segments(rows: DataFrame) -> DataFrame:
    """One row a segment, stored: (part, k) is its place among the conversation's, ``whole`` whether it is all of it, and
    ``lines`` then the repaired lines, otherwise the rows as they are."""
    schema = _facts(rows.schema["conv_id"], whole=T.BooleanType(), opens=T.StringType(), closes=T.StringType(),
                    links=T.ArrayType(LINK), lines=LINES)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "_row"]
    # rows of one turn that are alike: the first of them has the smallest number
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def cut(rows):
        from pyspark import TaskContext

        part, seg, inside = TaskContext.get().partitionId(), None, False
        for conv, turn, role, text, first in rows:
            if seg is None:
                seg = Segment(part, conv, 0, None)
            elif conv != seg.conv:
                yield seg.out(inside and seg.k == 0)
                seg, inside = Segment(part, conv, 0, None), True
            elif len(seg.rows) >= SEGMENT or seg.room >= ROOM:
                yield seg.out(False)
                seg = Segment(part, conv, seg.k + 1, seg.before)
            seg.add(turn, role, text, not first)
        if seg is not None:  # the next partition may go on with it
            yield seg.out(False)

    return store(_stream(rows.select("conv_id", "turn", "role", "text", "first"), schema, cut, _room))


def chained(cuts: DataFrame) -> DataFrame:
    """One row a conversation, from its segments in order: ``FACTS``, summed up, and the audit of all."""
    id_type = cuts.schema["conv_id"]
    cols = ["conv_id", "k", "low", "high", "turns", *COUNTS, "opens", "closes", "links"]
    ordered = cuts.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), "part", "k").select(cols)

    def join(rows):
        here, conv = None, None

        def out():
            cost, audit = min(here["heads"][s] for s in ENDS if s in here["heads"])
            return (conv, -1, -1, here["low"], here["high"], here["turns"], *here["n"], cost, audit)

        for own, k, low, high, turns, *n, opens, closes, links in rows:
            if here is None or own != conv:
                if here is not None:
                    yield out()
                conv = own
                here = {"heads": {0: (0, "")}, "low": None, "high": None, "turns": 0, "n": [0] * len(COUNTS), "last": None}
            if k == 0 and here["last"] is not None:  # a new partition: what lies between it and the one before
                n[-1] += here["last"] + opens not in ("su", "ua", "au")
                turns -= low is not None and low == here["high"]
            here["heads"] = chain(here["heads"], links)
            here["low"] = low if here["low"] is None else here["low"]
            here["high"] = here["high"] if high is None else high
            here["turns"] += turns
            here["n"] = [a + b for a, b in zip(here["n"], n, strict=True)]
            here["last"] = closes
        if here is not None:
            yield out()

    return store(_stream(ordered, _facts(id_type), join, lambda row: len(row[-1])))


def written(cuts: DataFrame, facts: DataFrame) -> DataFrame:
    """(conv_id, part, k, lines): the repaired lines, a segment a row, of the conversations of ``facts``."""
    id_type = cuts.schema["conv_id"]
    head = facts.select("conv_id", "part", "k", "audit", F.lit(None).cast(LINES).alias("lines"))
    both = head.unionByName(cuts.select("conv_id", "part", "k", F.lit(None).cast("string").alias("audit"), "lines"))
    ordered = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), "part", "k")

    def write(rows):
        writer = conv = place = None
        for own, part, k, audit, lines in rows:
            if audit is not None:
                if writer is not None:
                    yield (conv, *place, writer.inserts())
                writer, conv = Writer(audit), own
            else:
                place = part, k + 1
                yield own, part, k, [y for x in lines for y in writer.row(**x)]
        if writer is not None:
            yield (conv, *place, writer.inserts())

    schema = _schema(id_type, part=T.LongType(), k=T.LongType(), lines=LINES)
    return store(_stream(ordered, schema, write, _room))


def repair(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Facts and repaired lines of conversations.

    The first table has one row a conversation: ``FACTS`` (first and last turn, distinct turns, faults, illegal pairs,
    cost) and the audit.  The second has the repaired lines as arrays of (role, text), of which (part, k) is the order;
    ``whole`` says that it is the only one of its conversation.
    """
    rows = pick(conv, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    cuts = segments(firsts(rows.fillna(" ", ["role", "text"])))
    done, parts = cuts.where("whole"), cuts.where("NOT whole")
    joined = chained(parts)
    facts = done.select(joined.columns).unionByName(joined).drop("part", "k")
    lines = done.select("conv_id", "part", "k", "lines", "whole").unionByName(
        written(parts, joined).withColumn("whole", F.lit(False)))
    return facts, lines


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of ``role:text`` lines, joined by newlines."""
    def line(x):
        return F.concat(x["role"], F.lit(":"), x["text"])

    whole = lines.where("whole").select("conv_id", F.sha2(F.array_join(F.transform("lines", line), "\n").cast("binary"), 256)
                                        .alias("repaired_sha256"))
    long = lines.where("NOT whole").select("conv_id", "part", "k", "lines").repartition("conv_id") \
        .sortWithinPartitions(F.col("conv_id"), "part", "k")

    def run(rows):
        state = conv = None
        empty = True
        for own, _, _, new in rows:
            if state is None or own != conv:
                if state is not None:
                    yield conv, state.hexdigest()
                state, conv, empty = sha256(), own, True
            for x in new:
                state.update((("" if empty else "\n") + x["role"] + ":" + x["text"]).encode())
                empty = False
        if state is not None:
            yield conv, state.hexdigest()

    schema = _schema(lines.schema["conv_id"], repaired_sha256=T.StringType())
    return whole.unionByName(_stream(long, schema, run))


def repaired(conv: DataFrame) -> DataFrame:
    """The contract's row for every conversation of the table, whose rows are damaged first."""
    conv = pick(conv, conv_id="conv_id", turn="turn", role="role", text="text")
    facts, lines = repair(damaged(conv))
    asked = conv.select("conv_id").distinct()
    facts, hashes = facts.withColumnRenamed("conv_id", "_f"), digests(lines).withColumnRenamed("conv_id", "_h")
    out = asked.join(facts, F.col("conv_id").eqNullSafe(F.col("_f")) & F.col("cost").isNotNull(), "left").join(
        hashes, F.col("conv_id").eqNullSafe(F.col("_h")) & F.col("repaired_sha256").isNotNull(), "left")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return out.select("conv_id", gaps.alias("gaps"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (*COUNTS, "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """The same in SQL: the cheapest edits by recursion over the rows, one state of the lattice a column."""
    key = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    core = r"regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')"

    def step(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {state}.l || {line}}}"

    def best(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL))[1]"

    def insert(state: str, role: str) -> str:
        return step(state, "3", "I", f"'{role}:' || chr(10)")

    def closed(e: str, s: str, u: str, a: str, source: str) -> str:
        """States with inserts after ``source`` has them without."""
        return f"""SELECT * REPLACE ({best(a, insert(u, 'assistant'))} AS a) FROM (
    SELECT * REPLACE ({best(u, insert(e, 'user'), insert(s, 'user'), insert(a, 'user'))} AS u) FROM ({source}))"""

    drop = "CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END END"

    def rerole(state: str, role: str) -> str:
        return step(state, f"3 + {drop}", "R", f"'{role}:' || text || chr(10)")

    def keep(state: str, initial: str) -> str:
        return step(state, f"CASE WHEN ini = '{initial}' THEN {drop} END", "K", "role || ':' || text || chr(10)")

    none = "{'c': CAST(NULL AS BIGINT), 'a': '', 'l': ''}"
    moved = f"""SELECT w.conv_id, r.pos, {step('e', '4', 'D')} AS e,
      {best(step('s', '4', 'D'), keep('e', 's'))} AS s,
      {best(step('u', '4', 'D'), *[rerole(x, 'user') for x in 'esa'], *[keep(x, 'u') for x in 'esa'])} AS u,
      {best(step('a', '4', 'D'), rerole('u', 'assistant'), keep('u', 'a'))} AS a
    FROM walk w JOIN found r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1"""
    begun = (f"SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 'l': ''}} AS e, "
             f"{none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM found)")
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} % 20 AS k
  FROM conversations),
broken AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again FROM keyed WHERE k <> 0),
placed AS (SELECT *, substring(role, 1, 1) AS ini, {core} AS core,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM broken),
found AS (SELECT *, CASE WHEN core = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM placed),
walk AS ({closed('e', 's', 'u', 'a', begun)}
  UNION ALL
  {closed('e', 's', 'u', 'a', moved)}),
facts AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM found GROUP BY conv_id),
ended AS (SELECT f.*, {best('w.e', 'w.a')} AS z
  FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.n)
SELECT c.conv_id, coalesce(z.gaps, 0) AS gaps, coalesce(z.blank, 0) AS blank, coalesce(z.duplicate, 0) AS duplicate,
  coalesce(z.truncated, 0) AS truncated, coalesce(z.illegal, 0) AS illegal, coalesce(z.z.c, 0) AS cost,
  coalesce(z.z.a, '') AS audit, sha256(coalesce(left(z.z.l, length(z.z.l) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""
