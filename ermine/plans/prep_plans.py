"""Corpus preparation (P*) and classification (C*) plans over the given tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import corpus as P
from ..operators import annotate as A
from ..session import cut_lineage_by
from . import fixtures as FX
from .sql_annotate import annotate_ctes
from .sql_rules import all_hits_ctes

EXCLUDED_MODELS = ["src0"]  # P7 fixture: one partially labelled source


def _ann_sql():
    return "WITH RECURSIVE " + annotate_ctes("SELECT doc_id, text, source FROM documents")


# ---- corpus preparation ---------------------------------------------------------

def q_label_kind_pairs(spark, sf):  # P1
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    return P.label_kind_pairs(docs, FX.table(spark, sf, "labels"), "doc_id", "doc_id", "text", "quality")


SQL_P1 = """SELECT d.doc_id AS id, d.text AS english, CAST(l.quality AS VARCHAR) AS kind
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


def q_grouped_texts(spark, sf):  # P2
    return P.group_texts(FX.table(spark, sf, "conversations"), "conv_id", "turn", "text")


SQL_P2 = """SELECT conv_id, string_agg(CASE WHEN text LIKE '%.' THEN text ELSE text || '.' END, ' ' ORDER BY turn)
  AS text FROM conversations GROUP BY conv_id"""


def q_role_lists(spark, sf):  # P5
    return P.conjunctive_list(FX.table(spark, sf, "conversations"), "conv_id", "turn", "role")


SQL_P5 = """SELECT conv_id, CASE WHEN len(l) = 1 THEN l[1]
  ELSE array_to_string(l[1:len(l) - 1], ',') || ' and ' || l[len(l)] END AS joined
FROM (SELECT conv_id, list(role ORDER BY turn, role) AS l FROM conversations GROUP BY conv_id)"""


def q_rebuilt_sentences(spark, sf):  # P3
    return P.rebuild_sentences(FX.doc_tokens(spark, sf))


SQL_P3 = _ann_sql() + """
SELECT doc_id, sent_id, trim(string_agg(text, ' ' ORDER BY tok_id)) AS sentence FROM toks GROUP BY doc_id, sent_id"""


def q_split_dataset(spark, sf):  # P6
    known = FX.labelled(spark, sf)
    return P.split_dataset(known, A.sentences(known), known.select("doc_id", F.col("label").alias("kind")),
                           FX.sentence_kinds(spark, sf))


def kinds_ctes() -> str:
    """``kinds`` of all sentences of ``sents``: the Bernoulli model (C4) of those whose rule results (``all_hits``) are of
    one kind; the better score to six places, ties to the smaller kind."""
    return r"""k_known AS (SELECT doc_id, sent_id, min(kind) AS label FROM all_hits GROUP BY ALL HAVING min(kind) = max(kind)),
k_all AS (SELECT DISTINCT doc_id, sent_id, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]{2,}')) AS term FROM sents),
k_pres AS (SELECT * FROM k_all JOIN k_known USING (doc_id, sent_id)),
k_nc AS (SELECT label, count(*) AS n_c FROM k_known GROUP BY label),
k_vocab AS (SELECT DISTINCT term FROM k_pres),
k_params AS (SELECT label, term, ln((n_cf + 1.0) / (n_c + 2.0)) AS lt, ln(1.0 - (n_cf + 1.0) / (n_c + 2.0)) AS l1t
  FROM (SELECT label, term, count(*) AS n_cf FROM k_pres GROUP BY ALL) JOIN k_nc USING (label)),
k_base AS (SELECT label, ln(n_c / (SELECT CAST(count(*) AS DOUBLE) FROM k_known)) + coalesce(s_seen, 0)
    + ((SELECT count(*) FROM k_vocab) - coalesce(k_seen, 0)) * ln(1.0 - 1.0 / (n_c + 2.0)) AS base,
    ln(1.0 / (n_c + 2.0)) - ln(1.0 - 1.0 / (n_c + 2.0)) AS w0
  FROM k_nc LEFT JOIN (SELECT label, sum(l1t) AS s_seen, count(*) AS k_seen FROM k_params GROUP BY label) USING (label)),
k_terms AS (SELECT * FROM k_all JOIN k_vocab USING (term)),
k_np AS (SELECT doc_id, sent_id, count(*) AS n_p FROM k_terms GROUP BY ALL),
k_m AS (SELECT doc_id, sent_id, label, sum(lt - l1t) AS s_m, count(*) AS k_m FROM k_terms JOIN k_params USING (term) GROUP BY ALL),
k_scores AS (SELECT s.doc_id, s.sent_id, b.label,
    round(base + coalesce(s_m, 0) + (coalesce(n_p, 0) - coalesce(k_m, 0)) * w0, 6) AS score
  FROM sents s CROSS JOIN k_base b LEFT JOIN k_np USING (doc_id, sent_id) LEFT JOIN k_m USING (doc_id, sent_id, label)),
kinds AS (SELECT doc_id, sent_id, arg_min(label, {'s': -score, 'l': label}) AS kind FROM k_scores GROUP BY ALL)"""


SQL_P6 = _ann_sql() + f""",
{all_hits_ctes()},
{kinds_ctes()},
k_docs AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN 'class' ELSE 'rel' END AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM sents JOIN k_docs USING (doc_id) GROUP BY doc_id)
SELECT c.doc_id, c.text AS english, c.label AS kind, CAST(NULL AS INTEGER) AS offset
FROM k_docs c JOIN n ON n.doc_id = c.doc_id WHERE n.n = 1
UNION ALL
SELECT s.doc_id, s.sentence AS english, kind, s.sent_id AS offset
FROM sents s JOIN n ON n.doc_id = s.doc_id JOIN kinds k ON k.doc_id = s.doc_id AND k.sent_id = s.sent_id WHERE n.n > 1"""


def q_kinds(spark, sf):  # C12 on sentences
    return FX.sentence_kinds(spark, sf)


SQL_KINDS = _ann_sql() + ",\n" + all_hits_ctes() + ",\n" + kinds_ctes() + "\nSELECT * FROM kinds"


def q_excluded_models(spark, sf):  # P7
    docs = FX.corpus(spark, sf).select("doc_id", F.col("source").alias("model"))
    excl = spark.createDataFrame([(m,) for m in EXCLUDED_MODELS], "model string")
    return P.exclude_models(docs, excl)


SQL_P7 = f"""SELECT source AS model, doc_id FROM documents
  WHERE source NOT IN ({', '.join("'" + m + "'" for m in EXCLUDED_MODELS)})"""


def q_fragment_lookup(spark, sf):  # P9
    cust = FX.table(spark, sf, "customer").join(
        FX.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    frags = cust.select("c_custkey", F.col("n_name").alias("model"), F.lower("c_mktsegment").alias("kind"),
                        F.col("c_custkey").alias("number"))
    orders = FX.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return P.fragment_lookup(orders, frags, "o_custkey", "c_custkey")


SQL_P9 = """SELECT o.o_orderkey, o.o_custkey, printf('%s_%s%d', n.n_name, lower(c.c_mktsegment), c.c_custkey)
  AS fragment
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"""


def q_antecedents(spark, sf):  # P4a
    return P.nearest_antecedents(FX.doc_tokens(spark, sf))


_SQL_ANTECEDENTS = """(
  SELECT *, last_value(CASE WHEN pos IN ('NOUN', 'PROPN') AND tok_id = chunk_root THEN text END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY sent_id, tok_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS antecedent
  FROM toks)"""
SQL_P4A = _ann_sql() + f"""
SELECT doc_id, sent_id, tok_id, text, antecedent FROM {_SQL_ANTECEDENTS} WHERE text IN ('it', 'them')"""


def q_resolved_sentences(spark, sf):  # P4 with P4a's mentions, then P3
    toks = FX.doc_tokens(spark, sf)
    return P.resolved_sentences(toks, P.antecedent_mentions(toks))


SQL_P4 = _ann_sql() + f"""
SELECT doc_id, sent_id, trim(string_agg(CASE WHEN text IN ('it', 'them') THEN coalesce(antecedent, text) ELSE text END,
  ' ' ORDER BY tok_id)) AS sentence FROM {_SQL_ANTECEDENTS} GROUP BY doc_id, sent_id"""


# ---- classification ------------------------------------------------------------

def _labelled(spark, sf):
    """(doc_id, text, label), dealt out by document in pieces that one task counts in memory."""
    d = A.by_document(FX.table(spark, sf, "documents").select("doc_id", "text"), FX.doc_pieces(spark, sf))
    return d.join(FX.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def _tf_split(spark, sf, stored=False):
    """``stored``: the counts are made once, for who reads them many times."""
    ld = _labelled(spark, sf)
    tf = C.term_counts(ld)
    if stored:
        tf = cut_lineage_by(tf, "doc_id", FX.doc_pieces(spark, sf))
    train = tf.join(ld.select("doc_id", "label"), "doc_id").filter(F.col("doc_id") % 5 != 0)
    test = tf.filter(F.col("doc_id") % 5 == 0)
    return ld, tf, train, test


def q_term_counts(spark, sf):  # C2
    return C.term_counts(_labelled(spark, sf))


_LD = r"""ld AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf
       FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM ld)
       GROUP BY doc_id, term),
train AS (SELECT tf.doc_id, tf.term, tf.tf, ld.label FROM tf JOIN ld ON ld.doc_id = tf.doc_id
          WHERE tf.doc_id % 5 <> 0),
test AS (SELECT * FROM tf WHERE doc_id % 5 = 0)"""

SQL_C2 = "WITH " + _LD + " SELECT doc_id, term, tf FROM tf"


def q_tfidf(spark, sf):  # C3
    ld, _, train, test = _tf_split(spark, sf)
    w = C.tfidf(train.select("doc_id", "term", "tf"), test, C.key_split(ld, "doc_id")[0])
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


SQL_C3 = "WITH " + _LD + """,
n AS (SELECT count(*) AS n FROM ld WHERE doc_id % 5 <> 0),
idf AS (SELECT term, ln((1.0 + n.n) / (count(*) + 1.0)) + 1.0 AS idf FROM train, n GROUP BY term, n.n),
w AS (SELECT t.doc_id, t.term, t.tf * idf.idf AS w FROM test t JOIN idf ON idf.term = t.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


def _nb_table(spark, sf, kind):
    ld, _, train, test = _tf_split(spark, sf)
    train_docs, test_docs = C.key_split(ld, "doc_id")
    fit = C.bernoulli_nb if kind == "bernoulli" else C.multinomial_nb
    scores = fit(train, test, train_docs=train_docs, test_docs=test_docs)
    pred = C.predict(scores)
    t = C.prediction_table(pred, ld.select("doc_id", "label"))
    return t.select("doc_id", "truth", "prediction", F.round("score", 6).alias("score"))


def q_bernoulli(spark, sf):  # C4 + C12 + C14
    return _nb_table(spark, sf, "bernoulli")


def q_multinomial(spark, sf):  # C5 + C12 + C14
    return _nb_table(spark, sf, "multinomial")


def q_report(spark, sf):  # C13
    r = C.report(q_bernoulli(spark, sf))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


_PICK = """pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rk
                             FROM scores) WHERE rk = 1)
SELECT p.doc_id, ld.label AS truth, p.label AS prediction, round(p.score, 6) AS score
FROM pick p JOIN ld ON ld.doc_id = p.doc_id"""

_NB_COMMON = """docs AS (SELECT doc_id, label FROM ld WHERE doc_id % 5 <> 0),
nc AS (SELECT label, count(*) AS n_c FROM docs GROUP BY label),
nall AS (SELECT count(*) AS n FROM docs),
vocab AS (SELECT DISTINCT term FROM train),
v AS (SELECT count(*) AS v FROM vocab),
tdocs AS (SELECT doc_id FROM ld WHERE doc_id % 5 = 0)"""

SQL_C4 = "WITH " + _LD + ",\n" + _NB_COMMON + """,
ncf AS (SELECT label, term, count(DISTINCT doc_id) AS n_cf FROM train GROUP BY label, term),
params AS (SELECT ncf.label, ncf.term, ln((n_cf + 1.0) / (n_c + 2.0)) AS lt, ln(1.0 - (n_cf + 1.0) / (n_c + 2.0)) AS l1t
           FROM ncf JOIN nc ON nc.label = ncf.label),
seen AS (SELECT label, sum(l1t) AS s_seen, count(*) AS k_seen FROM params GROUP BY label),
base AS (SELECT nc.label, ln(n_c / CAST(nall.n AS DOUBLE)) + coalesce(s_seen, 0)
                + (v.v - coalesce(k_seen, 0)) * ln(1.0 - 1.0 / (n_c + 2.0)) AS base,
                ln(1.0 / (n_c + 2.0)) - ln(1.0 - 1.0 / (n_c + 2.0)) AS w0
         FROM nc LEFT JOIN seen ON seen.label = nc.label CROSS JOIN nall CROSS JOIN v),
present AS (SELECT DISTINCT t.doc_id, t.term FROM test t JOIN vocab ON vocab.term = t.term),
np AS (SELECT doc_id, count(*) AS n_p FROM present GROUP BY doc_id),
matched AS (SELECT p.doc_id, pa.label, sum(lt - l1t) AS s_m, count(*) AS k_m
            FROM present p JOIN params pa ON pa.term = p.term GROUP BY p.doc_id, pa.label),
scores AS (SELECT t.doc_id, b.label,
             b.base + coalesce(m.s_m, 0) + (coalesce(np.n_p, 0) - coalesce(m.k_m, 0)) * b.w0 AS score
           FROM tdocs t CROSS JOIN base b LEFT JOIN np ON np.doc_id = t.doc_id
           LEFT JOIN matched m ON m.doc_id = t.doc_id AND m.label = b.label),
""" + _PICK

SQL_C5 = "WITH " + _LD + ",\n" + _NB_COMMON + """,
tcf AS (SELECT label, term, sum(tf) AS t_cf FROM train GROUP BY label, term),
tc AS (SELECT label, sum(t_cf) AS t_c FROM tcf GROUP BY label),
params AS (SELECT tcf.label, tcf.term, ln((t_cf + 1.0) / (t_c + v.v)) AS lt
           FROM tcf JOIN tc ON tc.label = tcf.label CROSS JOIN v),
base AS (SELECT nc.label, ln(n_c / CAST(nall.n AS DOUBLE)) AS prior, ln(1.0 / (coalesce(t_c, 0) + v.v)) AS l0
         FROM nc LEFT JOIN tc ON tc.label = nc.label CROSS JOIN nall CROSS JOIN v),
present AS (SELECT t.doc_id, t.term, t.tf FROM test t JOIN vocab ON vocab.term = t.term),
tot AS (SELECT doc_id, sum(tf) AS w_all FROM present GROUP BY doc_id),
matched AS (SELECT p.doc_id, pa.label, sum(p.tf * pa.lt) AS s_m, sum(p.tf) AS w_m
            FROM present p JOIN params pa ON pa.term = p.term GROUP BY p.doc_id, pa.label),
scores AS (SELECT t.doc_id, b.label,
             b.prior + coalesce(m.s_m, 0) + (coalesce(tot.w_all, 0) - coalesce(m.w_m, 0)) * b.l0 AS score
           FROM tdocs t CROSS JOIN base b LEFT JOIN tot ON tot.doc_id = t.doc_id
           LEFT JOIN matched m ON m.doc_id = t.doc_id AND m.label = b.label),
""" + _PICK

SQL_C13 = f"""WITH t AS (SELECT CAST(truth AS VARCHAR) AS truth, CAST(prediction AS VARCHAR) AS prediction
           FROM ({SQL_C4})),
lab AS (SELECT truth AS label FROM t UNION SELECT prediction FROM t),
j AS (SELECT lab.label,
        (SELECT count(*) FROM t WHERE t.truth = lab.label AND t.prediction = lab.label) AS tp,
        (SELECT count(*) FROM t WHERE t.truth = lab.label) AS support,
        (SELECT count(*) FROM t WHERE t.prediction = lab.label) AS n_pred FROM lab),
per AS (SELECT label, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM j),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
           AS f1 FROM per)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)
  FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support) FROM per2
UNION ALL SELECT 'accuracy', round(avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END), 6),
  round(avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END), 6),
  round(avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END), 6), count(*) FROM t"""


def _neighbours(spark, sf):
    ld, tf, train, test = _tf_split(spark, sf, stored=True)
    train_docs, test_docs = C.key_split(ld, "doc_id")
    fitted = train.select("doc_id", "term", "tf")
    return C.nearest(C.tfidf(fitted, fitted, train_docs), C.tfidf(fitted, test, train_docs), train_docs, test_docs), train_docs


def q_neighbours(spark, sf):  # C6
    return _neighbours(spark, sf)[0].withColumn("similarity", F.round("similarity", 6))


def q_knn(spark, sf):  # C6 + C14
    near, train_docs = _neighbours(spark, sf)
    return C.prediction_table(C.vote(near, train_docs), _labelled(spark, sf).select("doc_id", "label"))


_KNN = "WITH " + _LD + """,
n AS (SELECT count(*) AS n FROM ld WHERE doc_id % 5 <> 0),
idf AS (SELECT term, ln((1.0 + n.n) / (count(*) + 1.0)) + 1.0 AS idf FROM train, n GROUP BY term, n.n),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w
      FROM (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON idf.term = tf.term)),
pairs AS (SELECT q.doc_id, d.doc_id AS neighbour FROM ld q JOIN ld d ON q.doc_id % 5 = 0 AND d.doc_id % 5 <> 0),
dots AS (SELECT a.doc_id, b.doc_id AS neighbour, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.term = b.term
         WHERE a.doc_id % 5 = 0 AND b.doc_id % 5 <> 0 GROUP BY ALL),
near AS (SELECT * FROM (SELECT p.doc_id, p.neighbour, round(coalesce(s, 0), 9) AS similarity,
           row_number() OVER (PARTITION BY p.doc_id ORDER BY round(coalesce(s, 0), 9) DESC, p.neighbour) AS rank
         FROM pairs p LEFT JOIN dots USING (doc_id, neighbour)) WHERE rank <= 3)"""

SQL_NEAR = _KNN + " SELECT doc_id, neighbour, round(similarity, 6) AS similarity, rank FROM near"

SQL_KNN = _KNN + """ SELECT v.doc_id, q.label AS truth, v.prediction FROM (
  SELECT doc_id, arg_min(label, {'n': -n, 'l': label}) AS prediction
  FROM (SELECT near.doc_id, ld.label, count(*) AS n FROM near JOIN ld ON ld.doc_id = near.neighbour GROUP BY ALL) GROUP BY doc_id) v
JOIN ld q ON q.doc_id = v.doc_id"""


def q_ml_grid(spark, sf):  # C7-C11 (Spark ML; rows-only check): label = English or not
    d = FX.table(spark, sf, "documents").select(
        "doc_id", "text", (F.col("lang") == "en").cast("double").alias("label"))
    train, test = C.key_split(d, "doc_id")
    return C.leaderboard(train, test)     # every model on both vectorizers


PREP_QUERIES = {
    "p1_label_kind_pairs": q_label_kind_pairs,
    "p2_grouped_texts": q_grouped_texts,
    "p3_rebuilt_sentences": q_rebuilt_sentences,
    "p4_resolved_sentences": q_resolved_sentences,
    "p4a_pronoun_antecedents": q_antecedents,
    "p5_conjunctive_role_lists": q_role_lists,
    "p6_split_dataset": q_split_dataset,
    "p7_excluded_models": q_excluded_models,
    "c12_sentence_kinds": q_kinds,
    "p9_fragment_lookup": q_fragment_lookup,
    "c2_term_counts": q_term_counts,
    "c3_tfidf_weights": q_tfidf,
    "c4_c12_c14_bernoulli_predictions": q_bernoulli,
    "c5_multinomial_predictions": q_multinomial,
    "c13_classification_report": q_report,
    "c6_nearest_neighbours": q_neighbours,
    "c6_knn_predictions": q_knn,
    "c7_c11_model_grid": q_ml_grid,
}

PREP_ORACLE = {
    "p1_label_kind_pairs": SQL_P1,
    "p2_grouped_texts": SQL_P2,
    "p3_rebuilt_sentences": SQL_P3,
    "p4_resolved_sentences": SQL_P4,
    "p4a_pronoun_antecedents": SQL_P4A,
    "p5_conjunctive_role_lists": SQL_P5,
    "p6_split_dataset": SQL_P6,
    "p7_excluded_models": SQL_P7,
    "c12_sentence_kinds": SQL_KINDS,
    "p9_fragment_lookup": SQL_P9,
    "c2_term_counts": SQL_C2,
    "c3_tfidf_weights": SQL_C3,
    "c4_c12_c14_bernoulli_predictions": SQL_C4,
    "c5_multinomial_predictions": SQL_C5,
    "c13_classification_report": SQL_C13,
    "c6_nearest_neighbours": SQL_NEAR,
    "c6_knn_predictions": SQL_KNN,
}
