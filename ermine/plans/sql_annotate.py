"""DuckDB-dialect SQL of the shallow annotator (oracle side of T1-T5).

Written independently of the DataFrame code in ``operators/annotate.py``; only
the fixed values (lexicon, patterns) are shared.
"""

from __future__ import annotations

from ..functions.lexicon import lexicon_rows, values_sql
from ..functions.text import SENTENCE_SPLIT, TOKEN_PATTERN


def _cap(x: str) -> str:
    return f"(upper(substring({x}, 1, 1)) || lower(substring({x}, 2)))"


def _isupper(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def annotate_ctes(corpus_sql: str, with_test_words: bool = True) -> str:
    """CTEs ``corpus, sents, toks, chunk_names, token_names`` (no leading WITH)."""
    lex = values_sql(lexicon_rows(with_test_words), ["word", "lex_pos", "lex_lemma", "lex_stop"], "l")
    W = "PARTITION BY doc_id, sent_id ORDER BY tok_id"
    ALL = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    UPTO = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    BEFORE = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    FROM = f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    AFTER = f"({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    chunkable = "pos IN ('DET','ADJ','NUM','NOUN','PROPN')"
    noun = "pos IN ('NOUN','PROPN')"
    return f"""
corpus AS ({corpus_sql}),
sents AS (
  SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, trim(part) AS sentence
  FROM (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(0, len(parts) - 1)) AS sent_id
        FROM (SELECT doc_id, regexp_split_to_array(text, '{SENTENCE_SPLIT}') AS parts FROM corpus))
  WHERE trim(part) <> ''),
raw_toks AS (
  SELECT doc_id, sent_id, CAST(tok_id AS INTEGER) AS tok_id, text
  FROM (SELECT doc_id, sent_id, unnest(ts) AS text, unnest(generate_series(0, len(ts) - 1)) AS tok_id
        FROM (SELECT doc_id, sent_id, regexp_extract_all(sentence, '{TOKEN_PATTERN}') AS ts FROM sents))),
lexed AS (
  SELECT r.doc_id, r.sent_id, r.tok_id, r.text, lower(r.text) AS lower,
    coalesce(l.lex_pos, CASE WHEN regexp_full_match(r.text, '[0-9]+') THEN 'NUM'
                             WHEN regexp_full_match(r.text, '[A-Za-z]+') THEN 'NOUN' ELSE 'PUNCT' END) AS pos0,
    coalesce(l.lex_lemma, CASE WHEN regexp_full_match(r.text, '[A-Za-z]+') AND length(r.text) > 3
                                    AND lower(r.text) LIKE '%s' AND lower(r.text) NOT LIKE '%ss'
                               THEN substring(lower(r.text), 1, length(r.text) - 1)
                               WHEN regexp_full_match(r.text, '[A-Za-z]+') THEN lower(r.text)
                               ELSE r.text END) AS lemma,
    coalesce(l.lex_stop, FALSE) AS is_stop
  FROM raw_toks r LEFT JOIN {lex} ON lower(r.text) = l.word),
a1 AS (
  SELECT *, CASE WHEN lower = 'at' AND lead(lower) OVER ({W}) = 'least' THEN 'ADV' ELSE pos0 END AS pos
  FROM lexed),
a2 AS (
  SELECT *, {chunkable} AS chunkable,
    min(CASE WHEN NOT ({chunkable}) THEN tok_id END) OVER {FROM} AS next_break,
    min(CASE WHEN NOT ({chunkable}) THEN tok_id END) OVER {AFTER} AS next_break_after,
    min(CASE WHEN {noun} THEN tok_id END) OVER {AFTER} AS next_noun_after,
    max(CASE WHEN NOT ({chunkable}) THEN tok_id END) OVER {UPTO} AS pre_tok,
    last_value(CASE WHEN NOT ({chunkable}) THEN pos END IGNORE NULLS) OVER {UPTO} AS pre_pos,
    last_value(CASE WHEN NOT ({chunkable}) THEN text END IGNORE NULLS) OVER {UPTO} AS pre_text,
    lead(pos) OVER ({W}) AS next_pos,
    lead(lemma) OVER ({W}) AS next_lemma,
    lag(lemma) OVER ({W}) AS prev_lemma,
    min(CASE WHEN pos = 'AUX' AND lemma = 'be' THEN tok_id END) OVER {ALL} AS first_be,
    max(tok_id) OVER {ALL} AS max_tok
  FROM a1),
a3 AS (
  SELECT *, min(CASE WHEN {noun} AND (next_noun_after IS NULL OR (next_break_after IS NOT NULL
                 AND next_break_after < next_noun_after)) THEN tok_id END) OVER {FROM} AS first_root_from
  FROM a2),
a4 AS (
  SELECT *, coalesce(chunk_root = tok_id, FALSE) AS is_cr
  FROM (SELECT *, CASE WHEN chunkable AND first_root_from IS NOT NULL
                        AND (next_break IS NULL OR first_root_from < next_break) THEN first_root_from END AS chunk_root
        FROM a3)),
a5 AS (
  SELECT *,
    max(CASE WHEN is_cr THEN tok_id END) OVER {BEFORE} AS prev_cr,
    lag(chunk_root) OVER ({W}) AS prev_chunk_root,
    (pos = 'VERB' AND lemma = 'name' AND coalesce(lag(is_cr) OVER ({W}), FALSE) AND prev_lemma = 'class')
      AS is_acl_name,
    CAST(count(CASE WHEN is_cr THEN 1 END) OVER {ALL} AS INTEGER) AS n_chunks,
    count(CASE WHEN text IN ('.', '!', '?') AND tok_id < max_tok THEN 1 END) OVER {ALL} > 0 AS multi_sent,
    min(CASE WHEN is_cr THEN tok_id END) OVER {ALL} AS first_cr
  FROM a4),
a6 AS (
  SELECT *,
    coalesce(last_value(CASE WHEN NOT chunkable THEN is_acl_name END IGNORE NULLS) OVER {UPTO}, FALSE) AS pre_is_acl,
    min(CASE WHEN pos = 'VERB' AND NOT is_acl_name THEN tok_id END) OVER {ALL} AS first_verb
  FROM a5),
a7 AS (SELECT *, coalesce(first_verb, first_be, first_cr) AS r FROM a6),
a8 AS (
  SELECT *,
    max(CASE WHEN is_cr AND tok_id < r AND NOT coalesce(pre_pos = 'ADP', FALSE) THEN tok_id END) OVER {ALL} AS nsubj_c,
    min(CASE WHEN is_cr AND tok_id > r THEN tok_id END) OVER {ALL} AS c1,
    min(CASE WHEN pos = 'ADP' AND tok_id > r THEN tok_id END) OVER {ALL} AS adp_after_r,
    min(CASE WHEN pos IN ('ADP', 'VERB', 'AUX') AND tok_id > r THEN tok_id END) OVER {ALL} AS stop_after_r,
    max(CASE WHEN pos = 'AUX' AND lemma = 'be' AND tok_id < r THEN tok_id END) OVER {ALL} AS be_before_r
  FROM a7),
a9 AS (
  SELECT *, first_verb IS NOT NULL AS r_verb, first_verb IS NULL AND first_be IS NOT NULL AS r_be,
    CASE WHEN first_verb IS NOT NULL OR first_be IS NOT NULL THEN nsubj_c END AS nsubj,
    CASE WHEN (first_verb IS NOT NULL OR first_be IS NOT NULL) AND c1 IS NOT NULL
              AND (adp_after_r IS NULL OR adp_after_r > c1) THEN c1 END AS dobj
  FROM a8),
a10 AS (
  SELECT *, coalesce(r_verb AND nsubj IS NOT NULL AND be_before_r IS NOT NULL AND be_before_r > nsubj, FALSE)
              AS passive
  FROM a9),
a11 AS (
  SELECT *,
    CASE WHEN is_cr THEN
      CASE WHEN tok_id = r THEN 'ROOT'
           WHEN pre_is_acl THEN 'oprd'
           WHEN pre_pos = 'ADP' THEN 'pobj'
           WHEN pre_pos = 'CCONJ' THEN 'conj'
           WHEN pre_text = ',' AND dobj IS NOT NULL AND tok_id > dobj
                AND (stop_after_r IS NULL OR tok_id < stop_after_r) THEN 'appos'
           WHEN tok_id = nsubj THEN CASE WHEN passive THEN 'nsubjpass' ELSE 'nsubj' END
           WHEN tok_id = dobj THEN CASE WHEN r_be THEN 'attr' ELSE 'dobj' END
           ELSE 'dep' END
    ELSE
      CASE WHEN tok_id = r THEN 'ROOT'
           WHEN chunk_root IS NOT NULL AND pos = 'DET' THEN 'det'
           WHEN chunk_root IS NOT NULL AND pos = 'ADJ' THEN 'amod'
           WHEN chunk_root IS NOT NULL AND pos = 'NUM' THEN 'nummod'
           WHEN chunk_root IS NOT NULL THEN 'compound'
           WHEN pos = 'ADP' THEN 'prep'
           WHEN pos = 'CCONJ' THEN 'cc'
           WHEN pos = 'ADV' THEN 'advmod'
           WHEN pos = 'AUX' THEN CASE WHEN passive AND tok_id > nsubj AND tok_id < r THEN 'auxpass' ELSE 'aux' END
           WHEN pos = 'PRON' AND lemma = 'there' AND next_lemma = 'be' THEN 'expl'
           WHEN is_acl_name THEN 'acl'
           WHEN pos = 'PUNCT' THEN 'punct'
           ELSE 'dep' END
    END AS dep,
    CASE WHEN is_cr THEN
      CASE WHEN tok_id = r THEN NULL
           WHEN pre_is_acl THEN pre_tok
           WHEN pre_pos = 'ADP' THEN pre_tok
           WHEN pre_pos = 'CCONJ' THEN coalesce(prev_cr, r)
           WHEN pre_text = ',' AND dobj IS NOT NULL AND tok_id > dobj
                AND (stop_after_r IS NULL OR tok_id < stop_after_r) THEN dobj
           ELSE r END
    ELSE
      CASE WHEN tok_id = r THEN NULL
           WHEN chunk_root IS NOT NULL THEN chunk_root
           WHEN pos = 'ADP' THEN coalesce(prev_chunk_root, r)
           WHEN pos = 'CCONJ' THEN coalesce(prev_cr, r)
           WHEN pos = 'ADV' THEN CASE WHEN next_pos IN ('NUM', 'ADV') THEN tok_id + 1 ELSE r END
           WHEN pos = 'PRON' AND lemma = 'there' AND next_lemma = 'be' THEN tok_id + 1
           WHEN is_acl_name THEN tok_id - 1
           ELSE r END
    END AS head0
  FROM a10),
toks AS (
  SELECT doc_id, sent_id, tok_id, text, lemma, pos, dep,
         CAST(CASE WHEN head0 = tok_id THEN NULL ELSE head0 END AS INTEGER) AS head,
         is_stop, chunk_root, n_chunks, multi_sent
  FROM a11),
cn_pieces AS (
  SELECT doc_id, sent_id, chunk_root, tok_id,
    CASE WHEN NOT is_stop AND text <> 'exactly' THEN
      CASE WHEN {_isupper('text')} THEN text WHEN tok_id = chunk_root THEN {_cap('lemma')} ELSE {_cap('text')} END
    END AS p3,
    CASE WHEN NOT is_stop THEN CASE WHEN {_isupper('text')} THEN text ELSE lemma END END AS p4,
    CASE WHEN NOT is_stop AND tok_id <> chunk_root THEN
      CASE WHEN {_isupper('text')} THEN text ELSE {_cap('lemma')} END END AS p5,
    CASE WHEN tok_id = chunk_root THEN text END AS root_text,
    CASE WHEN tok_id = chunk_root THEN lemma END AS root_lemma
  FROM toks WHERE chunk_root IS NOT NULL),
cn_agg AS (
  SELECT doc_id, sent_id, chunk_root,
    string_agg(p3, '' ORDER BY tok_id) AS pascal_raw,
    string_agg(p5, '' ORDER BY tok_id) AS explicit_raw,
    string_agg({_cap('p4')}, '' ORDER BY tok_id) AS cap4,
    arg_min(p4, tok_id) FILTER (WHERE p4 IS NOT NULL) AS first4,
    max(root_text) AS root_text, max(root_lemma) AS root_lemma
  FROM cn_pieces GROUP BY doc_id, sent_id, chunk_root),
chunk_names AS (
  SELECT doc_id, sent_id, chunk_root,
    CASE WHEN pascal_raw IS NULL OR pascal_raw = '' THEN
      CASE WHEN {_isupper('root_text')} THEN root_text ELSE {_cap('root_lemma')} END
    ELSE pascal_raw END AS pascal,
    CASE WHEN cap4 IS NULL OR cap4 = '' THEN
      CASE WHEN {_isupper('root_text')} THEN root_text ELSE root_lemma END
    ELSE first4 || substring(cap4, length(first4) + 1) END AS camel,
    CASE WHEN explicit_raw IS NOT NULL AND explicit_raw <> '' THEN explicit_raw END AS explicit
  FROM cn_agg),
token_names AS (
  SELECT t.doc_id, t.sent_id, t.tok_id, t.lemma,
    coalesce(c.pascal, CASE WHEN NOT regexp_full_match(t.text, '[A-Za-z0-9]+') THEN t.text
                            WHEN {_isupper('t.text')} THEN t.text ELSE {_cap('t.lemma')} END) AS pascal,
    coalesce(c.camel, CASE WHEN NOT regexp_full_match(t.text, '[A-Za-z0-9]+') THEN t.text
                           WHEN {_isupper('t.text')} THEN t.text ELSE t.lemma END) AS camel,
    c.explicit
  FROM toks t LEFT JOIN chunk_names c
    ON t.doc_id = c.doc_id AND t.sent_id = c.sent_id AND t.tok_id = c.chunk_root)
"""
