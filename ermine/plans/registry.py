"""Registered queries (one per operator with volume on the given tables) and their SQL oracles.

Keys carry the SURVEY operator ids.  Every query reads whole tables from
``sf_dir``; every oracle is DuckDB SQL over the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import annotate as A
from ..operators import corpus as P
from ..operators import evaluate as E
from ..operators import extract as X
from ..operators.rules import RULES, RULES_BY_ID
from ..session import checkpoint_dir
from ..sources.ecore import ecore_lines, last_reference, read_ecore
from ..sources.models import read_plantuml, write_plantuml
from . import fixtures as FX
from .sql_annotate import annotate_ctes
from .sql_model import (assemble_ctes, class_scores_sql, equality_sql, flat, PART_FIXTURE, part_truth_pred_ctes,
                        rel_scores_sql, signature_scores_sql, size_similarity_sql, summary_sql)
from ..operators.assemble import flat as flat_rows
from .prep_plans import kinds_ctes, PREP_ORACLE, PREP_QUERIES
from .sql_rules import all_hits_ctes, priority_values, rule_ctes

CORPUS_SQL = "SELECT doc_id, text, source FROM documents"


def _ann() -> str:
    return "WITH RECURSIVE " + annotate_ctes(CORPUS_SQL)


def _best_ctes() -> str:
    return f"""{all_hits_ctes()},
{kinds_ctes()},
disp AS (SELECT h.* FROM all_hits h JOIN kinds k ON k.doc_id = h.doc_id AND k.sent_id = h.sent_id
         WHERE h.kind = k.kind),
best AS (SELECT doc_id, sent_id, rule, kind, cls, attr1, attr2, attr3, attr_type, src, dst, mult, rel_name,
                mult_ambiguous
         FROM (SELECT d.*, row_number() OVER (PARTITION BY d.doc_id, d.sent_id
                                              ORDER BY pr.priority NULLS LAST, d.rule) AS rk
               FROM disp d LEFT JOIN {priority_values()} ON pr.rule = d.rule) WHERE rk = 1)"""


def _doc_fragment_ctes() -> str:
    return f"""{_best_ctes()},
bm AS (SELECT b.*, c.source AS model, {{'doc_id': b.doc_id, 'sent_id': b.sent_id}} AS seq
       FROM best b JOIN corpus c ON c.doc_id = b.doc_id),
d_fc AS (SELECT model, seq, 0 AS class_pos, cls AS class_name, kind FROM bm WHERE kind = 'class'
         UNION ALL SELECT model, seq, 0 AS class_pos, src AS class_name, kind FROM bm WHERE kind = 'rel'
         UNION ALL SELECT model, seq, 1 AS class_pos, dst AS class_name, kind FROM bm WHERE kind = 'rel'),
d_fa AS (SELECT model, seq, class_name, CAST(i - 1 AS INTEGER) AS attr_pos, attr_name, attr_type
         FROM (SELECT model, seq, cls AS class_name, attr_type, unnest([attr1, attr2, attr3]) AS attr_name,
                      unnest([1, 2, 3]) AS i FROM bm WHERE kind = 'class')
         WHERE attr_name IS NOT NULL),
d_fr AS (SELECT model, seq, src, dst, mult, rel_name FROM bm WHERE kind = 'rel'),
{assemble_ctes('d_', 'd_fc', 'd_fa', 'd_fr')}"""


# ---- Spark side ---------------------------------------------------------------

def q_sentences(spark, sf):  # T1 step 1
    return A.sentences(FX.corpus(spark, sf))


def q_tokens(spark, sf):  # T1 + T2 + T8
    return FX.doc_tokens(spark, sf)


def q_chunk_names(spark, sf):  # T3 + T4 + T5
    return A.chunk_names(FX.doc_tokens(spark, sf))


def _rule_query(rid: str):
    def q(spark, sf):
        return FX.doc_rule_hits(spark, sf, RULES_BY_ID[rid])
    return q


def q_best(spark, sf):  # R18 + R19
    return FX.doc_best(spark, sf)


def q_coverage(spark, sf):  # R21
    return X.coverage(FX.doc_hits(spark, sf), FX.sentence_kinds(spark, sf))


def q_doc_rels(spark, sf):  # minimum slice: documents -> rules -> A7 / A10
    return flat_rows(FX.doc_model(spark, sf)[2])


def q_doc_classes(spark, sf):
    return flat_rows(FX.doc_model(spark, sf)[0])


def q_doc_attributes(spark, sf):
    return flat_rows(FX.doc_model(spark, sf)[1])


def q_part_classes(spark, sf):  # A1-A4, A7, A9
    return flat_rows(FX.part_model(spark, sf)[0])


def q_part_attributes(spark, sf):  # A5, A6
    return flat_rows(FX.part_model(spark, sf)[1])


def q_part_rels(spark, sf):  # A6, A7, A10
    return flat_rows(FX.part_model(spark, sf)[2])


CLASSES, ATTRIBUTES, RELS = 0, 1, 2


def _truth_pred(spark, sf, *asked):
    m = FX.sided_models(spark, sf, asked)
    return m["truth"], m["prediction"]


def q_class_scores(spark, sf):  # E1 + E2
    (tc,), (pc,) = _truth_pred(spark, sf, CLASSES)
    return E.class_scores(pc, tc)


def q_rel_exact(spark, sf):  # E5
    (tc, tr), (pc, pr) = _truth_pred(spark, sf, CLASSES, RELS)
    return E.relation_scores(pc, pr, tc, tr)


def q_rel_relaxed(spark, sf):  # E6
    (tc, tr), (pc, pr) = _truth_pred(spark, sf, CLASSES, RELS)
    return E.relation_scores(pc, pr, tc, tr, relaxed=True)


def q_size_similarity(spark, sf):  # E8 + E16
    (tc, tr), (pc, pr) = _truth_pred(spark, sf, CLASSES, RELS)
    return E.size_similarity(pc, pr, tc, tr)


def q_summary(spark, sf):  # E11
    return E.score_summary(q_class_scores(spark, sf).unionByName(q_rel_exact(spark, sf))
                           .unionByName(q_rel_relaxed(spark, sf)))


def q_integrity(spark, sf):  # E10 (finds nothing after A9 / A10)
    c, _, r = FX.part_model(spark, sf)
    return E.integrity_violations(c, r)


def q_fragment_integrity(spark, sf):  # E10 on fragments as they are, which repeat each other
    fc, _, fr = FX.part_fragments(spark, sf)
    return E.integrity_violations(fc, fr)


def q_pairing(spark, sf):  # E1
    (tc,), (pc,) = _truth_pred(spark, sf, CLASSES)
    return E.pairing(pc, tc)


def q_signatures(typed: bool):  # E3, E4
    def q(spark, sf):
        (tc, ta), (pc, pa) = _truth_pred(spark, sf, CLASSES, ATTRIBUTES)
        return E.signature_scores(pc, pa, tc, ta, typed)
    return q


def q_equality(spark, sf):  # E12
    truth, pred = _truth_pred(spark, sf, CLASSES, ATTRIBUTES, RELS)
    return E.structural_equality(pred, truth)


def q_assembly_report(spark, sf):  # E15
    return E.assembly_report(q_equality(spark, sf))


def q_degrees(spark, sf):  # E16
    c, _, r = FX.part_model(spark, sf)
    return E.graph_degrees(c, r)


def q_semantics(spark, sf):  # E13: what the original's priorities choose against what the mended ones choose
    sides = [[t.select("*", "seq.doc_id", "seq.sent_id") for t in FX.doc_fragments(spark, sf, compat=c)] for c in (True, False)]
    return E.semantic_comparison(*sides, ["model", "doc_id", "sent_id"])     # by plain keys: rows are dealt out by doc_id


def q_semantics_status(spark, sf):  # E14, lists
    same = q_semantics(spark, sf).drop("model")
    return E.semantics_status(FX.sentence_kinds(spark, sf), same, ["doc_id", "sent_id"])


def q_semantics_report(spark, sf):  # E14, counts
    return E.semantics_report(q_semantics_status(spark, sf))


def q_unmatched(spark, sf):  # R21
    return X.unmatched_sentences(FX.doc_hits(spark, sf), FX.sentence_kinds(spark, sf))


def q_class_faults(spark, sf):  # R20 (finds nothing in fragments that rules make)
    return X.integrity(FX.doc_fragments(spark, sf)[0]).select("model", "seq.doc_id", "seq.sent_id", "kind", "n_classes")


def _ecore(i: int, *columns: str):  # S4: the part models, written and read back
    def q(spark, sf):
        return read_ecore(spark, FX.ecore_files(spark, sf))[i].select("model", *columns)
    return q


def q_ecore_last(spark, sf):  # S4a
    return last_reference(read_ecore(spark, FX.ecore_files(spark, sf))[2]).select("model", "src", "dst", "mult", "rel_name")


def q_ecore_diagrams(spark, sf):  # S8, read back by S5
    path = f"{checkpoint_dir(spark)}/diagrams-{uuid.uuid4().hex}"
    write_plantuml(ecore_lines(spark, FX.ecore_files(spark, sf)), path)
    return read_plantuml(spark, path)[2].select("model", "src", "dst", "mult", "rel_name")


def q_fragment_names(spark, sf):  # P8
    c, _, r = FX.part_model(spark, sf)
    return P.fragment_names(c, r)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "t1_sentences": q_sentences,
    "t1_tokens": q_tokens,
    "t3_t4_t5_chunk_names": q_chunk_names,
    **{f"{rid.lower()}_rule_hits": _rule_query(rid) for rid in RULES_BY_ID},
    "r18_r19_selected_fragments": q_best,
    "r21_rule_coverage": q_coverage,
    "a1_doc_model_rels": q_doc_rels,
    "a1_doc_model_classes": q_doc_classes,
    "a1_doc_model_attributes": q_doc_attributes,
    "a1_part_model_classes": q_part_classes,
    "a5_a6_part_model_attributes": q_part_attributes,
    "a7_a10_part_model_rels": q_part_rels,
    "e2_class_scores": q_class_scores,
    "e5_rel_scores_exact": q_rel_exact,
    "e6_rel_scores_relaxed": q_rel_relaxed,
    "e8_size_similarity": q_size_similarity,
    "e10_integrity_violations": q_integrity,
    "e10_fragment_violations": q_fragment_integrity,
    "e11_score_summary": q_summary,
    "e1_paired_models": q_pairing,
    "e3_class_scores_exact": q_signatures(True),
    "e4_class_scores_untyped": q_signatures(False),
    "e12_structural_equality": q_equality,
    "e13_semantic_comparison": q_semantics,
    "e14_semantics_status": q_semantics_status,
    "e14_semantics_report": q_semantics_report,
    "e15_assembly_report": q_assembly_report,
    "e16_graph_degrees": q_degrees,
    "r20_fragment_integrity": q_class_faults,
    "s4_ecore_classes": _ecore(0, "class_pos", "class_name"),
    "s4_ecore_attributes": _ecore(1, "class_name", "attr_name", "attr_type"),
    "s4_ecore_references": _ecore(2, "src", "dst", "mult", "rel_name"),
    "s4a_ecore_last_reference": q_ecore_last,
    "s8_ecore_diagram_relations": q_ecore_diagrams,
    "p8_fragment_names": q_fragment_names,
    "r21_unmatched_sentences": q_unmatched,
    **PREP_QUERIES,
}


# ---- oracle side ----------------------------------------------------------------

def _rule_sql(rid: str) -> str:
    return f"{_ann()},\n{rule_ctes(RULES_BY_ID[rid])}\nSELECT * FROM {rid.lower()}_hits"


def _coverage_sql() -> str:
    vals = ", ".join(f"('{r.rid}', '{r.kind}')" for r in RULES)
    return f"""{_ann()},
{all_hits_ctes()},
{kinds_ctes()},
cand AS (SELECT k.doc_id, k.sent_id, k.kind, r.rule FROM kinds k JOIN (VALUES {vals}) AS r(rule, kind)
         ON r.kind = k.kind),
hit AS (SELECT DISTINCT doc_id, sent_id, rule FROM all_hits)
SELECT c.kind, c.rule, count_if(h.rule IS NOT NULL) AS matched, count_if(h.rule IS NULL) AS unmatched
FROM cand c LEFT JOIN hit h ON h.doc_id = c.doc_id AND h.sent_id = c.sent_id AND h.rule = c.rule
GROUP BY ROLLUP (c.kind, c.rule)"""


def _unmatched_sql() -> str:
    return f"""{_ann()},
{all_hits_ctes()},
{kinds_ctes()}
SELECT * FROM kinds k WHERE NOT EXISTS (SELECT 1 FROM all_hits h WHERE h.doc_id = k.doc_id AND h.sent_id = k.sent_id
                                        AND h.kind = k.kind)"""


def _same_ctes() -> str:
    """``same``: sentences whose choice by the original's priorities (nothing that is unlisted, where there is more than
    one) means the same as the mended choice; the fragments of a sentence compared by columns."""
    both = "c.kind = b.kind AND (c.kind <> 'class' OR (lower(c.cls) = lower(b.cls) AND {a})) AND (c.kind <> 'rel' OR {r})"
    a = " AND ".join(f"c.attr{i} IS NOT DISTINCT FROM b.attr{i}" for i in (1, 2, 3))
    r = ("lower(c.src) = lower(b.src) AND lower(c.dst) = lower(b.dst) AND c.dst = b.dst AND c.mult = b.mult "
         "AND c.rel_name = b.rel_name")
    return f"""{_best_ctes()},
comp AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.doc_id, d.sent_id ORDER BY pr.priority NULLS LAST, d.rule) AS rk
         FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_id) AS n FROM disp) d
         LEFT JOIN {priority_values(True)} ON pr.rule = d.rule WHERE d.n = 1 OR pr.priority IS NOT NULL) WHERE rk = 1),
same AS (SELECT q.source AS model, b.doc_id, b.sent_id, {both.format(a=a, r=r)} AS same
         FROM best b JOIN comp c ON c.doc_id = b.doc_id AND c.sent_id = b.sent_id JOIN corpus q ON q.doc_id = b.doc_id),
status AS (SELECT k.doc_id, k.sent_id, k.kind,
             CASE WHEN s.same IS NULL THEN 'failed' WHEN s.same THEN 'passed' ELSE 'wrong' END AS status
           FROM kinds k LEFT JOIN same s ON s.doc_id = k.doc_id AND s.sent_id = k.sent_id)"""


_DEGREES_SQL = f"""WITH {PART_FIXTURE},
{assemble_ctes('a_', 'all_fc', 'all_fa', 'all_fr')},
e AS (SELECT model, src AS class_name FROM a_model_rels UNION ALL
      SELECT model, dst FROM a_model_rels WHERE dst <> src)
SELECT c.model, c.class_name, count(e.class_name) AS degree
FROM a_model_classes c LEFT JOIN e ON e.model = c.model AND e.class_name = c.class_name GROUP BY ALL"""

_FRAGMENT_FAULTS_SQL = f"""WITH {PART_FIXTURE}
SELECT model, 'duplicate class' AS violation, class_name AS item, count(*) AS n FROM all_fc
GROUP BY model, class_name HAVING count(*) > 1
UNION ALL
SELECT model, 'duplicate association', concat_ws(' ', src, dst, mult, rel_name), count(*)
FROM all_fr GROUP BY model, src, dst, mult, rel_name HAVING count(*) > 1"""

_PAIRING_SQL = f"""WITH {part_truth_pred_ctes()}
SELECT model, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true
FROM (SELECT model, count(*) AS n FROM p_model_classes GROUP BY model) p
FULL JOIN (SELECT model, count(*) AS n FROM t_model_classes GROUP BY model) t USING (model)"""


_REFERENCES = ("SELECT model, src, dst, CASE mult WHEN '' THEN '0..1' ELSE mult END AS mult, rel_name FROM a_model_rels")


def _part_sql(table: str, select: str | None = None) -> str:
    select = select or flat("a_" + table, "major", "minor")
    return f"WITH {PART_FIXTURE},\n{assemble_ctes('a_', 'all_fc', 'all_fa', 'all_fr')}\n{select}"


def _integrity_sql() -> str:
    return f"""WITH {PART_FIXTURE},
{assemble_ctes('a_', 'all_fc', 'all_fa', 'all_fr')}
SELECT model, 'duplicate class' AS violation, class_name AS item, count(*) AS n FROM a_model_classes
GROUP BY model, class_name HAVING count(*) > 1
UNION ALL
SELECT model, 'duplicate association' AS violation, concat_ws(' ', src, dst, mult, rel_name) AS item, count(*) AS n
FROM a_model_rels GROUP BY model, src, dst, mult, rel_name HAVING count(*) > 1"""


ORACLE: dict[str, str] = {
    "t1_sentences": f"{_ann()}\nSELECT doc_id, sent_id, sentence FROM sents",
    "t1_tokens": f"{_ann()}\nSELECT * FROM toks",
    "t3_t4_t5_chunk_names": f"{_ann()}\nSELECT * FROM chunk_names",
    **{f"{rid.lower()}_rule_hits": _rule_sql(rid) for rid in RULES_BY_ID},
    "r18_r19_selected_fragments": f"{_ann()},\n{_best_ctes()}\nSELECT * FROM best",
    "r21_rule_coverage": _coverage_sql(),
    "a1_doc_model_rels": f"{_ann()},\n{_doc_fragment_ctes()}\n{flat('d_model_rels', 'doc_id', 'sent_id')}",
    "a1_doc_model_classes": f"{_ann()},\n{_doc_fragment_ctes()}\n{flat('d_model_classes', 'doc_id', 'sent_id')}",
    "a1_doc_model_attributes": f"{_ann()},\n{_doc_fragment_ctes()}\n{flat('d_model_attributes', 'doc_id', 'sent_id')}",
    "a1_part_model_classes": _part_sql("model_classes"),
    "a5_a6_part_model_attributes": _part_sql("model_attributes"),
    "a7_a10_part_model_rels": _part_sql("model_rels"),
    "e2_class_scores": class_scores_sql(),
    "e5_rel_scores_exact": rel_scores_sql(False),
    "e6_rel_scores_relaxed": rel_scores_sql(True),
    "e8_size_similarity": size_similarity_sql(),
    "e10_integrity_violations": _integrity_sql(),
    "e10_fragment_violations": _FRAGMENT_FAULTS_SQL,
    "e11_score_summary": summary_sql(),
    "e1_paired_models": _PAIRING_SQL,
    "e3_class_scores_exact": signature_scores_sql(True),
    "e4_class_scores_untyped": signature_scores_sql(False),
    "e12_structural_equality": equality_sql(),
    "e13_semantic_comparison": f"{_ann()},\n{_same_ctes()}\nSELECT * FROM same",
    "e14_semantics_status": f"{_ann()},\n{_same_ctes()}\nSELECT * FROM status",
    "e14_semantics_report": f"{_ann()},\n{_same_ctes()}\nSELECT kind, status, count(*) AS n FROM status GROUP BY CUBE (kind, status)",
    "e15_assembly_report": f"SELECT model, CASE WHEN equal THEN 'passed' ELSE 'failed' END AS status, n_pred, n_true "
                           f"FROM ({equality_sql()})",
    "e16_graph_degrees": _DEGREES_SQL,
    "r20_fragment_integrity": f"""{_ann()},\n{_doc_fragment_ctes()}
SELECT model, seq.doc_id AS doc_id, seq.sent_id AS sent_id, kind, count(*) AS n_classes FROM d_fc
GROUP BY ALL HAVING count(*) <> CASE kind WHEN 'class' THEN 1 ELSE 2 END""",
    "r21_unmatched_sentences": _unmatched_sql(),
    "s4_ecore_classes": _part_sql("model_classes", "SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY o) - 1 "
                                  "AS INTEGER) AS class_pos, class_name FROM a_model_classes"),
    "s4_ecore_attributes": _part_sql("model_attributes", "SELECT model, class_name, attr_name, attr_type FROM a_model_attributes"),
    "s4_ecore_references": _part_sql("model_rels", _REFERENCES),
    "s4a_ecore_last_reference": _part_sql("model_rels", f"""SELECT r.* FROM ({_REFERENCES}) r JOIN (
  SELECT r.model, arg_max({{'s': r.src, 'd': r.dst, 'n': r.rel_name}}, {{'c': c.o, 'r': r.o}}) AS k FROM a_model_rels r
  JOIN a_model_classes c ON c.model = r.model AND c.class_name = r.src GROUP BY ALL) l
  ON l.model = r.model AND l.k.s = r.src AND l.k.d = r.dst AND l.k.n = r.rel_name"""),
    "s8_ecore_diagram_relations": _part_sql("model_rels", _REFERENCES),
    "p8_fragment_names": _part_sql("model_rels", """SELECT model, kind, item,
  printf('%s_%s%d', model, kind, row_number() OVER (PARTITION BY model, kind ORDER BY o, item)) AS fragment
FROM (SELECT model, 'class' AS kind, o, class_name AS item FROM a_model_classes
      UNION ALL SELECT model, 'rel', o, concat_ws(' ', src, dst, rel_name) FROM a_model_rels)"""),
    **PREP_ORACLE,
}

_ = part_truth_pred_ctes  # re-exported for tests
