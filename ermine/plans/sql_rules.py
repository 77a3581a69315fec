"""DuckDB SQL for the rule layer (oracle side of R0-R21), rendered from the rule data.

Expects the CTEs of ``sql_annotate.annotate_ctes`` (``toks``, ``token_names``).
Descendants use a recursive CTE here, while the DataFrame side climbs the head
chain with a loop of joins, so the two sides are computed differently.
"""

from __future__ import annotations

from ..functions.lexicon import CLASS_PRIORITY, CLASS_PRIORITY_COMPAT, REL_PRIORITY, REL_PRIORITY_COMPAT
from ..operators.rules import RULES, Rule


def _in(col, vals, neg=False):
    lst = ", ".join("'" + v + "'" for v in vals)
    return f"{col} {'NOT IN' if neg else 'IN'} ({lst})"


def _conds(alias, role):
    out = []
    if role.lemma:
        out.append(_in(f"{alias}.lemma", role.lemma))
    if role.lemma_not:
        out.append(_in(f"{alias}.lemma", role.lemma_not, True))
    if role.pos:
        out.append(_in(f"{alias}.pos", role.pos))
    if role.dep:
        out.append(_in(f"{alias}.dep", role.dep))
    return out


def rule_ctes(rule: Rule) -> str:
    """CTEs ``<rid>_desc`` (if needed) and ``<rid>_hits``; no leading WITH."""
    rid = rule.rid.lower()
    alias = {r.name: f"t{i}" for i, r in enumerate(rule.roles)}
    froms = [f"toks {alias[rule.roles[0].name]}"]
    where = _conds(alias[rule.roles[0].name], rule.roles[0])
    ctes = []
    root_roles = {rule.roles[0].name} if rule.roles[0].dep == ("ROOT",) else set()
    for role in rule.roles[1:]:
        a, p = alias[role.name], alias[role.parent]
        same = f"{a}.doc_id = {p}.doc_id AND {a}.sent_id = {p}.sent_id"
        if role.op == ">":
            froms.append(f"JOIN toks {a} ON {same} AND {a}.head = {p}.tok_id")
        elif role.parent in root_roles:
            froms.append(f"JOIN toks {a} ON {same} AND {a}.tok_id <> {p}.tok_id")
        else:
            d = f"{rid}_desc_{role.name}"
            base = " AND ".join(["head IS NOT NULL"] + [c.replace("x.", "") for c in _conds("x", role)])
            ctes.append(f"""{d}(doc_id, sent_id, desc_id, anc_id) AS (
  SELECT doc_id, sent_id, tok_id, head FROM toks WHERE {base}
  UNION ALL
  SELECT d.doc_id, d.sent_id, d.desc_id, t.head FROM {d} d
  JOIN toks t ON t.doc_id = d.doc_id AND t.sent_id = d.sent_id AND t.tok_id = d.anc_id
  WHERE t.head IS NOT NULL)""")
            froms.append(f"JOIN {d} {a}_d ON {a}_d.doc_id = {p}.doc_id AND {a}_d.sent_id = {p}.sent_id "
                         f"AND {a}_d.anc_id = {p}.tok_id")
            froms.append(f"JOIN toks {a} ON {a}.doc_id = {p}.doc_id AND {a}.sent_id = {p}.sent_id "
                         f"AND {a}.tok_id = {a}_d.desc_id")
        where += _conds(a, role)
        if role.dep == ("ROOT",):
            root_roles.add(role.name)
    for x, y in rule.distinct:
        where.append(f"{alias[x]}.tok_id <> {alias[y]}.tok_id")
    a0 = alias[rule.roles[0].name]
    if rule.single_sentence:
        where.append(f"NOT {a0}.multi_sent")
    if rule.single_chunk:
        where.append(f"{a0}.n_chunks = 1 AND {a0}.chunk_root = {a0}.tok_id")
    sel = [f"{a0}.doc_id", f"{a0}.sent_id"] + [f"{alias[r.name]}.tok_id AS {r.name}" for r in rule.roles]
    matches = f"SELECT {', '.join(sel)} FROM {' '.join(froms)} WHERE {' AND '.join(where) or 'TRUE'}"

    joins, outs = [], {}
    named = []
    if rule.cls:
        named.append(("cls", rule.cls))
    for i, a in enumerate(rule.attrs):
        named.append((f"attr{i + 1}", a))
    if rule.src:
        named += [("src", rule.src), ("dst", rule.dst)]
    if rule.rel_name:
        named.append(("rel_name", rule.rel_name))
    for i, (out, (kind, role)) in enumerate(named):
        joins.append(f"LEFT JOIN token_names n{i} ON n{i}.doc_id = m.doc_id AND n{i}.sent_id = m.sent_id "
                     f"AND n{i}.tok_id = m.{role}")
        outs[out] = f"n{i}.{kind}"
    order = ", ".join(f"m.{r.name} DESC" for r in rule.roles)
    cols = ", ".join(f"{v} AS {k}" for k, v in outs.items())
    filt = "WHERE n0.explicit IS NOT NULL" if rule.cls and rule.cls[0] == "explicit" else (
        "WHERE n0.pascal IS NOT NULL" if rule.cls else "")
    picked = f"""SELECT m.doc_id, m.sent_id{', ' + cols if cols else ''},
  row_number() OVER (PARTITION BY m.doc_id, m.sent_id ORDER BY {order}) AS rk
  FROM ({matches}) m {' '.join(joins)} {filt}"""
    ns = "CAST(NULL AS VARCHAR)"

    def c(name, present):
        return name if present else ns
    final = f"""SELECT doc_id, sent_id, '{rule.rid}' AS rule, '{rule.kind}' AS kind,
  {c('cls', rule.cls)} AS cls,
  {c('attr1', len(rule.attrs) > 0)} AS attr1, {c('attr2', len(rule.attrs) > 1)} AS attr2,
  {c('attr3', len(rule.attrs) > 2)} AS attr3,
  {("'" + rule.attr_type + "'") if (rule.attrs and rule.attr_type is not None) else ns} AS attr_type,
  {c('src', rule.src)} AS src, {c('dst', rule.src)} AS dst,
  {"''" if rule.src else ns} AS mult,
  {("coalesce(rel_name, '')" if rule.rel_name else "''") if rule.src else ns} AS rel_name,
  FALSE AS mult_ambiguous
FROM ({picked}) WHERE rk = 1"""
    ctes.append(f"{rid}_hits AS ({final})")
    return ",\n".join(ctes)


def all_hits_ctes(rules=None) -> str:
    rules = rules or [r for r in RULES if not r.multiplicity]
    body = ",\n".join(rule_ctes(r) for r in rules)
    union = " UNION ALL ".join(f"SELECT * FROM {r.rid.lower()}_hits" for r in rules)
    return body + f",\nall_hits AS ({union})"


def priority_values(compat: bool = False) -> str:
    lists = (CLASS_PRIORITY_COMPAT, REL_PRIORITY_COMPAT) if compat else (CLASS_PRIORITY, REL_PRIORITY)
    rows = [f"('{r}', {i})" for own in lists for i, r in enumerate(own)]
    return f"(VALUES {', '.join(rows)}) AS pr(rule, priority)"
