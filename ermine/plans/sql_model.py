"""DuckDB SQL for the model side: assembly fixture, assembly (A1-A10) and scores (E*)."""

from __future__ import annotations


def _pascal(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), '')")


def _lower_first(x: str) -> str:
    return f"(lower(substring({x}, 1, 1)) || substring({x}, 2))"


PART_FIXTURE = f"""
part_p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, {_pascal('p_name')} AS pname FROM part),
part_x AS (SELECT a.*, b.pname AS next_pname FROM part_p a LEFT JOIN part_p b ON b.p_partkey = a.p_partkey + 1),
part_y AS (SELECT p_brand AS model, {{'major': p_partkey, 'minor': 0}} AS seq,
             CASE WHEN p_partkey % 17 = 0 THEN upper(pname) ELSE pname END AS class_name,
             CASE WHEN p_partkey % 29 = 0 AND next_pname IS NOT NULL THEN {_lower_first('next_pname')}
                  ELSE lower(p_type) END AS attr_name,
             CASE WHEN p_size % 2 = 1 THEN 'string' END AS attr_type
           FROM part_x),
all_fc AS (SELECT model, seq, 0 AS class_pos, class_name, 'class' AS kind FROM part_y),
all_fa AS (SELECT model, seq, class_name, 0 AS attr_pos, attr_name, attr_type FROM part_y),
li AS (SELECT l_orderkey, l_partkey, l_returnflag,
         row_number() OVER w AS rn, lead(l_partkey) OVER w AS next_part
       FROM lineitem
       WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
all_fr AS (SELECT a.p_brand AS model, {{'major': li.l_orderkey, 'minor': CAST(li.rn AS INTEGER)}} AS seq,
             a.pname AS src, b.pname AS dst,
             CASE li.rn % 3 WHEN 0 THEN '' WHEN 1 THEN '0..*' ELSE '1..1' END AS mult,
             lower(li.l_returnflag) AS rel_name
           FROM li JOIN part_p a ON a.p_partkey = li.l_partkey JOIN part_p b ON b.p_partkey = li.next_part
           WHERE li.next_part IS NOT NULL)"""


_MODEL = "{'side': 'prediction', 'model': CASE model WHEN 'Brand#7' THEN 'Brand#0' ELSE model END}"
_NAME = "CASE WHEN model <> 'Brand#5' AND seq.major % 5 = 0 THEN class_name || 'Item' ELSE class_name END"
_TURNED = "model <> 'Brand#5' AND (seq.major + seq.minor) % 13 = 0"
SIDED = f"""
s_fc AS (SELECT {{'side': 'truth', 'model': model}} AS model, * EXCLUDE (model) FROM all_fc
  UNION ALL BY NAME SELECT {_MODEL} AS model, seq, class_pos, {_NAME} AS class_name, kind FROM all_fc
  UNION ALL BY NAME SELECT {_MODEL} AS model, seq, class_pos, 'New' || class_name AS class_name, kind
    FROM all_fc WHERE model <> 'Brand#5' AND seq.major % 11 = 0),
s_fa AS (SELECT {{'side': 'truth', 'model': model}} AS model, * EXCLUDE (model) FROM all_fa
  UNION ALL BY NAME SELECT {_MODEL} AS model, seq, {_NAME} AS class_name, attr_pos, attr_name,
    CASE WHEN model <> 'Brand#5' AND seq.major % 3 = 0 THEN 'int' ELSE attr_type END AS attr_type FROM all_fa),
s_fr AS (SELECT {{'side': 'truth', 'model': model}} AS model, * EXCLUDE (model) FROM all_fr
  UNION ALL BY NAME SELECT {_MODEL} AS model, seq, CASE WHEN {_TURNED} THEN dst ELSE src END AS src,
    CASE WHEN {_TURNED} THEN src ELSE dst END AS dst,
    CASE WHEN model <> 'Brand#5' AND seq.major % 7 = 0 THEN '1..*' ELSE mult END AS mult, rel_name FROM all_fr)"""


def assemble_ctes(p: str, fc: str, fa: str, fr: str) -> str:
    """CTEs ``{p}model_classes``, ``{p}model_attributes``, ``{p}model_rels``; ``o`` is the order: class fragments, then
    relation fragments, by fragment, by place in it."""
    def o(phase: int, pos: str) -> str:
        return f"{{'phase': {phase}, 'seq': seq, 'pos': {pos}}}"

    return f"""
{p}canon AS (
  SELECT model, lower(class_name) AS lname, arg_min(class_name, o) AS class_name, min(o) AS o
  FROM (SELECT *, {o(0, 'class_pos')} AS o FROM {fc}) WHERE kind = 'class' GROUP BY model, lower(class_name)),
{p}attrs AS (
  SELECT a.model, c.class_name AS owner, a.attr_name,
         arg_min(a.attr_type, a.o) FILTER (WHERE a.attr_type IS NOT NULL) AS attr_type, min(a.o) AS o
  FROM (SELECT *, {o(0, 'attr_pos')} AS o FROM {fa}) a
  JOIN {p}canon c ON c.model = a.model AND c.lname = lower(a.class_name)
  GROUP BY a.model, c.class_name, a.attr_name),
{p}prom AS (
  SELECT a.model, a.owner, a.attr_name, c.class_name AS target, a.o
  FROM {p}attrs a JOIN {p}canon c ON c.model = a.model AND c.lname = lower(a.attr_name)
  WHERE lower(a.owner) <> c.lname),
{p}model_attributes AS (
  SELECT a.model, a.owner AS class_name, a.attr_name, a.attr_type, a.o FROM {p}attrs a
  WHERE NOT EXISTS (SELECT 1 FROM {p}prom x WHERE x.model = a.model AND x.owner = a.owner
                    AND x.attr_name = a.attr_name)),
{p}rels AS (SELECT model, src, dst, rel_name, mult, seq, {o(1, '0')} AS o FROM {fr}),
{p}ends AS (SELECT model, src AS class_name, o FROM {p}rels
            UNION ALL SELECT model, dst AS class_name, {o(1, '1')} AS o FROM {p}rels),
{p}model_classes AS (
  SELECT model, class_name, 'class' AS kind, o FROM {p}canon
  UNION ALL
  SELECT model, class_name, 'class' AS kind, min(o) AS o FROM {p}ends e
  WHERE NOT EXISTS (SELECT 1 FROM {p}canon c WHERE c.model = e.model AND c.class_name = e.class_name)
  GROUP BY model, class_name),
{p}model_rels AS (
  SELECT model, src, dst, rel_name, coalesce(arg_min(mult, o) FILTER (WHERE mult <> ''), '') AS mult, min(o) AS o
  FROM (SELECT model, src, dst, rel_name, mult, o FROM {p}rels
        UNION ALL
        SELECT model, owner, target, {_lower_first('target')}, '', o FROM {p}prom)
  GROUP BY model, src, dst, rel_name)"""


def flat(table: str, *keys: str) -> str:
    """A model table with its order as columns."""
    seq = ", ".join(f"o.seq.{k} AS first_{k}" for k in keys)
    return f"SELECT * EXCLUDE (o), o.phase AS first_phase, {seq}, o.pos AS first_pos FROM {table}"


def part_truth_pred_ctes() -> str:
    sides = ",\n".join(f"{x}_{t} AS (SELECT model.model AS model, * EXCLUDE (model) FROM s_{t} WHERE model.side = '{side}')"
                       for x, side in (("t", "truth"), ("p", "prediction"))
                       for t in ("model_classes", "model_attributes", "model_rels"))
    return ",\n".join([PART_FIXTURE, SIDED, assemble_ctes("s_", "s_fc", "s_fa", "s_fr"), sides])


def _f1(p, r):
    return f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


def class_scores_sql(keys: str = "class_name", target: str = "classes", classes: str = "model_classes",
                     more: str = "") -> str:
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in ("model, " + keys).split(","))
    return f"""WITH {part_truth_pred_ctes()}{more},
t AS (SELECT model, count(*) AS n_true FROM t_{classes} GROUP BY model),
p AS (SELECT model, count(*) AS n_pred FROM p_{classes} GROUP BY model),
tp AS (SELECT a.model, sum(a.n * b.n) AS pairs
       FROM (SELECT model, {keys}, count(*) AS n FROM p_{classes} GROUP BY ALL) a
       JOIN (SELECT model, {keys}, count(*) AS n FROM t_{classes} GROUP BY ALL) b ON {on} GROUP BY a.model),
s AS (SELECT model, coalesce(CAST(coalesce(tp.pairs, 0) AS DOUBLE) / p.n_pred, 0.0) AS precision,
        coalesce(CAST(coalesce(tp.pairs, 0) AS DOUBLE) / t.n_true, 0.0) AS recall
      FROM t FULL JOIN p USING (model) LEFT JOIN tp USING (model))
SELECT model, '{target}' AS target, precision, recall, {_f1('precision', 'recall')} AS f1 FROM s"""


def rel_scores_sql(relaxed: bool) -> str:
    keys = ["src", "dst"] if relaxed else ["src", "dst", "rel_name", "mult"]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ["model"] + keys)
    kl = ", ".join(keys)
    tgt = "rels_relaxed" if relaxed else "rels_exact"
    return f"""WITH {part_truth_pred_ctes()},
tc AS (SELECT model, count(*) AS n FROM t_model_classes GROUP BY model),
pc AS (SELECT model, count(*) AS n FROM p_model_classes GROUP BY model),
pr AS (SELECT model, count(*) AS n FROM p_model_rels GROUP BY model),
tr AS (SELECT model, count(*) AS n FROM t_model_rels GROUP BY model),
pairs AS (SELECT a.model, sum(a.n * b.n) AS pairs
          FROM (SELECT model, {kl}, count(*) AS n FROM p_model_rels GROUP BY ALL) a
          JOIN (SELECT model, {kl}, count(*) AS n FROM t_model_rels GROUP BY ALL) b ON {on}
          GROUP BY a.model),
s AS (SELECT model,
        CASE WHEN pc.n IS NULL OR tc.n IS NULL THEN 0.0
             WHEN coalesce(pr.n, 0) > 0 THEN CAST(coalesce(pairs.pairs, 0) AS DOUBLE) / pr.n
             WHEN coalesce(tr.n, 0) <> 0 THEN 0.0 ELSE 1.0 END AS precision,
        CASE WHEN pc.n IS NULL OR tc.n IS NULL THEN 0.0
             WHEN coalesce(tr.n, 0) > 0 THEN CAST(coalesce(pairs.pairs, 0) AS DOUBLE) / tr.n
             ELSE 1.0 END AS recall
      FROM tc FULL JOIN pc USING (model) LEFT JOIN pr USING (model) LEFT JOIN tr USING (model)
      LEFT JOIN pairs USING (model))
SELECT model, '{tgt}' AS target, precision, recall, {_f1('precision', 'recall')} AS f1 FROM s"""


def size_similarity_sql() -> str:
    return f"""WITH {part_truth_pred_ctes()},
c AS (SELECT model,
        CAST(coalesce(tc.n, 0) AS DOUBLE) AS gn, CAST(coalesce(tr.n, 0) AS DOUBLE) AS ge,
        CAST(coalesce(pc.n, 0) AS DOUBLE) AS pn, CAST(coalesce(pr.n, 0) AS DOUBLE) AS pe
      FROM (SELECT model, count(*) AS n FROM t_model_classes GROUP BY model) tc
      FULL JOIN (SELECT model, count(*) AS n FROM p_model_classes GROUP BY model) pc USING (model)
      LEFT JOIN (SELECT model, count(*) AS n FROM t_model_rels GROUP BY model) tr USING (model)
      LEFT JOIN (SELECT model, count(*) AS n FROM p_model_rels GROUP BY model) pr USING (model))
SELECT model, CASE WHEN sqrt(pn * pn + pe * pe) > 0 AND sqrt(gn * gn + ge * ge) > 0 THEN
  1 - sqrt(pow(pn / sqrt(pn * pn + pe * pe) - gn / sqrt(gn * gn + ge * ge), 2)
         + pow(pe / sqrt(pn * pn + pe * pe) - ge / sqrt(gn * gn + ge * ge), 2)) END AS size_similarity
FROM c"""


def summary_sql() -> str:
    parts = [class_scores_sql(), rel_scores_sql(False), rel_scores_sql(True)]
    inner = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in parts)
    return f"""SELECT target, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1,
  count(*) AS n_models FROM ({inner}) GROUP BY target"""


def signature_scores_sql(typed: bool) -> str:
    a = "{'n': attr_name, 't': attr_type}" if typed else "attr_name"
    sig = "".join(f""",
{x}_sig AS (SELECT c.model, c.class_name, coalesce(l.attrs, []) AS attrs FROM {x}_model_classes c
  LEFT JOIN (SELECT model, class_name, list({a} ORDER BY o) AS attrs FROM {x}_model_attributes GROUP BY ALL) l
  ON l.model = c.model AND l.class_name = c.class_name)""" for x in "tp")
    return class_scores_sql("class_name, attrs", "classes_exact" if typed else "classes_untyped", "sig", sig)


def equality_sql() -> str:
    sides = "".join(f""",
{x}_sig AS (SELECT c.model, c.class_name, c.kind, coalesce(l.attrs, []) AS attrs,
    row_number() OVER (PARTITION BY c.model ORDER BY c.o) AS place FROM {x}_model_classes c
  LEFT JOIN (SELECT model, class_name, list({{'n': attr_name, 't': attr_type}} ORDER BY o) AS attrs
             FROM {x}_model_attributes GROUP BY ALL) l ON l.model = c.model AND l.class_name = c.class_name)""" for x in "tp")
    return f"""WITH {part_truth_pred_ctes()}{sides}
SELECT coalesce(p.model, t.model) AS model, count(p.class_name) AS n_pred, count(t.class_name) AS n_true,
  bool_and(coalesce(p.class_name = t.class_name AND p.kind = t.kind
    AND p.attrs[1:least(len(p.attrs), len(t.attrs))] = t.attrs[1:least(len(p.attrs), len(t.attrs))], false)) AS equal
FROM p_sig p FULL JOIN t_sig t ON p.model = t.model AND p.place = t.place GROUP BY ALL"""
