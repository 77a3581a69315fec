"""Operator 13, Merkle manifest of a dataset with a proof for every row, by octopus multiproofs.

A row is a leaf; the leaves of a group, in order, form a tree by twos, a last odd node being hashed alone; the groups'
roots, in the order of the groups, form the tree above.  H is sha256 of the inputs' text, in lowercase hex.

Scale: leaves are numbered by a range partitioning on (group, id, leaf) and small counts, not by a window over a group,
so that a group that holds most rows is spread like any other.  ``BLOCK`` neighbouring leaves are a leaf partition.
Building goes up ``LEVELS`` levels a pass, a block of nodes at a time; a pass has 1 / ``BLOCK`` of the rows of the
one below.  Each leaf partition names the fewest nodes that prove all its leaves together and that it cannot derive
(:func:`missing`); all requests are joined to the stored nodes at once; then the partition derives the nodes inside and
expands the proof of each leaf from them.

Defined cases: null id, group or value is a value of its own, first in order, and a row with a null id never counts as
tampered; equal (group, id) are in the order of their leaves, and equal rows in any, so their proofs differ in place
only; very long texts are hashed in the JVM and leave it as a digest; an empty table gives an empty result; columns not
named are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_sql, pick, store

LEVELS = 10
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1             # the number of the tree above the groups' trees

Nodes = dict[int, dict[int, str]]  # by level, then by index


def h(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def size_at(n: int, level: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    return -(-n >> level)


def height(n: int) -> int:
    return (n - 1).bit_length()


def missing(own: list[int], n: int) -> list[tuple[int, int]]:
    """The octopus: (level, index) of the fewest nodes that prove leaves ``own`` of ``n`` together."""
    want, have = [], set(own)
    for level in range(height(n)):
        last = size_at(n, level) - 1
        want += [(level, i ^ 1) for i in sorted(have) if i ^ 1 not in have and i ^ 1 <= last]
        have = {i >> 1 for i in have}
    return want


def climb(nodes: Nodes, low: int, high: int, n: int) -> None:
    """Adds the parents on levels above ``low``, up to ``high``, whose children are all there."""
    for level in range(low, min(high, height(n))):
        here, above, last = nodes.get(level, {}), nodes.setdefault(level + 1, {}), size_at(n, level) - 1
        for i, left in here.items():
            if not i & 1 and (i == last or i + 1 in here):
                above[i >> 1] = h(left, here.get(i + 1, ""))


def path(nodes: Nodes, i: int, n: int) -> list[tuple[str, int]]:
    """(sibling, 1 if it stands left) of leaf ``i``, level by level; the sibling of an odd last node is empty."""
    out = []
    for level in range(height(n)):
        other = i >> level ^ 1
        out.append((nodes[level][other] if other < size_at(n, level) else "", i >> level & 1))
    return out


def fold(node: str, siblings: list[tuple[str, int]]) -> str:
    for other, left in siblings:
        node = h(other, node) if left else h(node, other)
    return node


# ---- leaves -------------------------------------------------------------------------------------

def leaf(fields: list[Column]) -> Column:
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place of a row in its group by ``order``, and ``n``, the rows of the group.

    Rows are range-partitioned by (group, order, a number of the row), so that neither a large group nor many equal
    rows stay together; a row's place is its place in the partition after the group's rows in those before.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    own = store(rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*keys, "_any")
                .sortWithinPartitions(*keys).drop("_any").withColumn("_at", F.monotonically_increasing_id()))
    runs = own.groupBy(F.col(group).alias("_g"), F.shiftright("_at", 33).alias("_part")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g")
    # a row a group and partition
    runs = store(runs.select("_g", "_part", F.sum("_n").over(w).alias("n"),
                             (F.sum("_n").over(w.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_add")))
    on = F.col(group).eqNullSafe(F.col("_g")) & (F.shiftright("_at", 33) == F.col("_part"))
    return own.join(runs, on).withColumn("idx", F.col("_at") + F.col("_add")).drop("_g", "_part", "_add", "_at")


# ---- nodes --------------------------------------------------------------------------------------

BUILT = T.StructType([T.StructField(c, T.LongType()) for c in ("tree", "n", "block", "at_tree", "level", "idx")]
                     + [T.StructField("node", T.StringType())])


def build(nodes: DataFrame, level: int, trees: int | None = None) -> DataFrame:
    """One pass up from (tree, n, idx, node) of ``level``, a block at a time.

    Gives the nodes (``BUILT``) of levels up to ``level + LEVELS``; from the leaves of the groups' trees (``trees``, the
    number of them, is given) only the highest of a block, and its requests: rows without ``node``.
    """
    def run(key, table):
        tree, block = key[0].as_py(), key[1].as_py()
        n = table.column("n")[0].as_py()
        own = dict(zip(table.column("idx").to_pylist(), table.column("node").to_pylist(), strict=True))
        known: Nodes = {level: own}
        climb(known, level, level + LEVELS, n)
        high = min(level + LEVELS, height(n))
        if trees is None:
            rows = [(TOP, lv, i, x) for lv in range(level, high + 1) for i, x in known[lv].items()]
        else:
            rows = [(TOP, high, i, x) for i, x in known[high].items()]
            rows += [(tree, lv, i, None) for lv, i in missing(list(own), n)]
            rows += [(TOP, lv, i, None) for lv, i in missing([tree], trees)]
        at, lv, idx, node = map(list, zip(*rows, strict=True))
        return pa.table([pa.array([x] * len(rows), pa.int64()) for x in (tree, n, block)]
                        + [pa.array(x, pa.int64()) for x in (at, lv, idx)] + [pa.array(node, pa.string())],
                        names=BUILT.names)

    cols = nodes.select("tree", "n", "idx", "node", F.shiftright("idx", LEVELS).alias("block"))
    return store(cols.groupBy("tree", "block").applyInArrow(run, BUILT))


def rise(built: DataFrame, tallest: int) -> DataFrame:
    """All stored nodes above the first pass ``built``, and its own: (tree, n, level, idx, node)."""
    cols, level = ["tree", "n", "level", "idx", "node"], LEVELS
    out = built.where("node IS NOT NULL").select(cols)
    while level < tallest:
        here = built.where((F.col("level") == level) & F.col("node").isNotNull() & (F.col("n") > 1 << level))
        built = build(here, level)
        out = out.unionByName(built.where(F.col("level") > level).select(cols))
        level += LEVELS
    return out


def manifest(docs: DataFrame, fields: list[Column], tried: Column | None = None, id_col: str = "doc_id",
             group_col: str = "lang") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a row of ``docs``.

    ``fields``: what a leaf is made of, in order, over the columns of ``docs``; ``tried``: another leaf to fold with the
    row's proof, null where the leaf itself is.
    """
    other = F.lit(None).cast("string") if tried is None else tried
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{group_col}`").alias("grp"),
                       leaf(fields).alias("leaf"), other.alias("tried"))
    rows = numbered(rows, "grp", ["doc_id", "leaf"])
    groups = rows.groupBy("grp").agg(F.max("n").alias("own")).withColumn("all", F.lit(0))
    groups = store(numbered(groups, "all", ["grp"]).select(F.col("grp").alias("_grp"), "own", F.col("idx").alias("tree")))
    facts = groups.agg(F.count(F.lit(1)).alias("trees"), F.max("own").alias("most")).first()
    trees, most = facts["trees"], facts["most"] or 0
    leaves = store(rows.join(groups.drop("own"), F.col("grp").eqNullSafe(F.col("_grp")))
                   .select("tree", "n", "idx", "doc_id", "leaf", "tried", F.shiftright("idx", LEVELS).alias("block")))

    first = build(leaves.withColumnRenamed("leaf", "node"), 0, trees)
    nodes = rise(first, height(most))
    roots = nodes.where((F.col("idx") == 0) & (F.expr("shiftleft(1L, CAST(level AS INT))") >= F.col("n"))
                        & ((F.col("level") == 0) | (F.expr("shiftleft(1L, CAST(level - 1 AS INT))") < F.col("n"))))
    over = build(roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"),
                              F.col("tree").alias("idx"), "node"), 0)
    nodes = nodes.unionByName(rise(over, height(trees)))
    wants = first.where("node IS NULL").select(F.col("tree").alias("for_tree"), "block", F.col("at_tree").alias("tree"),
                                               "level", "idx")
    fetched = wants.join(nodes.drop("n"), ["tree", "level", "idx"])

    id_type = leaves.schema["doc_id"]
    schema = T.StructType([id_type] + [T.StructField(c, T.StringType()) for c in
                                       ("leaf", "subroot", "root", "proof_sha256", "folded_root")])

    def prove(key, own, got):
        tree, n = key[0].as_py(), own.column("n")[0].as_py()
        known: dict[int, Nodes] = {tree: {}, TOP: {}}
        for t, lv, i, x in zip(*[got.column(c).to_pylist() for c in ("tree", "level", "idx", "node")], strict=True):
            known[t].setdefault(lv, {})[i] = x
        at, leafs = own.column("idx").to_pylist(), own.column("leaf").to_pylist()
        known[tree].setdefault(0, {}).update(zip(at, leafs, strict=True))
        climb(known[tree], 0, height(n), n)
        subroot = known[tree][height(n)][0]
        above = path(known[TOP], tree, trees)
        root = fold(subroot, above)
        proofs, folded = [], []
        for i, x, tried in zip(at, leafs, own.column("tried").to_pylist(), strict=True):
            siblings = path(known[tree], i, n) + above
            proofs.append(h(*[s for s, _ in siblings]))
            folded.append(fold(tried or x, siblings))
        m = own.num_rows
        return pa.table([own.column("doc_id"), own.column("leaf"), pa.array([subroot] * m), pa.array([root] * m),
                         pa.array(proofs), pa.array(folded)], names=schema.names)

    own = leaves.groupBy("tree", "block")
    out = own.cogroup(fetched.groupBy("for_tree", "block")).applyInArrow(prove, schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``; where 7 divides the crc32 of the id, the proof is tried with one character more
    in ``n_chars``, unless that is null."""
    docs = pick(docs, **{c: c for c in FIELDS})
    stake = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    return manifest(docs, [F.col(c) for c in FIELDS], F.when(stake & F.col("n_chars").isNotNull(), leaf(more)))


def oracle() -> str:
    """The same in SQL: levels and proofs by recursion."""
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def levels(name: str, start: str) -> str:
        return f"""{name} AS (
  SELECT g, CAST(0 AS BIGINT) AS lv, i, n, x FROM ({start})
  UNION ALL
  SELECT g, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY i)) FROM {name} WHERE n > 1
  GROUP BY g, lv, i // 2, n)"""

    def proofs(name: str, start: str, nodes: str) -> str:
        return f"""{name} AS (
  SELECT r, g, CAST(0 AS BIGINT) AS lv, i, n, p, f FROM ({start})
  UNION ALL
  SELECT q.r, q.g, q.lv + 1, q.i // 2, (q.n + 1) // 2, q.p || coalesce(s.x, ''),
    CASE WHEN q.i % 2 = 1 THEN sha256(s.x || q.f) ELSE sha256(q.f || coalesce(s.x, '')) END
  FROM {name} q LEFT JOIN {nodes} s ON s.g IS NOT DISTINCT FROM q.g AND s.lv = q.lv AND s.i = xor(q.i, 1)
  WHERE q.n > 1)"""

    more = [field("n_chars + 1" if c == "n_chars" else c) for c in FIELDS]
    return f"""WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({' || '.join(map(field, FIELDS))}) AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN sha256({' || '.join(more)}) END AS tried
  FROM documents),
leaves AS (SELECT *, row_number() OVER () AS r,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM d),
{levels('low', 'SELECT lang AS g, i, n, leaf AS x FROM leaves')},
subs AS (SELECT g AS lang, x, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n
         FROM low WHERE n = 1),
{levels('high', "SELECT 0 AS g, i, n, x FROM subs")},
{proofs('pl', "SELECT r, lang AS g, i, n, '' AS p, coalesce(tried, leaf) AS f FROM leaves", 'low')},
{proofs('ph', '''SELECT pl.r, 0 AS g, subs.i, subs.n, pl.p, pl.f
  FROM pl JOIN subs ON subs.lang IS NOT DISTINCT FROM pl.g WHERE pl.n = 1''', 'high')}
SELECT a.doc_id, a.leaf, s.x AS subroot, t.x AS root, sha256(q.p) AS proof_sha256, q.f AS folded_root,
  q.f = t.x AS verified
FROM ph q JOIN leaves a ON a.r = q.r JOIN subs s ON s.lang IS NOT DISTINCT FROM a.lang
JOIN high t ON t.n = 1 WHERE q.n = 1"""
