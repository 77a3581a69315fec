"""Fixed word lists of the engine, as small literal DataFrames.

Everything here is a bounded constant (tens of rows), so broadcasting it is
always safe whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEXICON_SCHEMA = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("lex_pos", T.StringType(), False),
    T.StructField("lex_lemma", T.StringType(), False),
    T.StructField("lex_stop", T.BooleanType(), False),
])

# ---- fixed values: closed-class lexicon of the shallow annotator --------------
# (word, part of speech, lemma, is stop word)
BASE_LEXICON = [
    ("is", "AUX", "be", True), ("was", "AUX", "be", True), ("are", "AUX", "be", True), ("be", "AUX", "be", True),
    ("with", "ADP", "with", True), ("by", "ADP", "by", True), ("of", "ADP", "of", True), ("in", "ADP", "in", True),
    ("on", "ADP", "on", True), ("to", "ADP", "to", True), ("for", "ADP", "for", True), ("at", "ADP", "at", True),
    ("from", "ADP", "from", True), ("as", "ADP", "as", True),
    ("the", "DET", "the", True), ("a", "DET", "a", True), ("an", "DET", "an", True), ("this", "DET", "this", True),
    ("that", "DET", "that", True),
    ("and", "CCONJ", "and", True),
    ("it", "PRON", "it", True), ("them", "PRON", "them", True), ("there", "PRON", "there", True),
    ("one", "NUM", "one", True), ("zero", "NUM", "zero", False),
    ("exactly", "ADV", "exactly", False), ("least", "ADV", "least", True),
    ("have", "VERB", "have", True), ("has", "VERB", "have", True), ("contain", "VERB", "contain", False),
    ("contains", "VERB", "contain", False), ("include", "VERB", "include", False),
    ("includes", "VERB", "include", False), ("comprise", "VERB", "comprise", False),
    ("compose", "VERB", "compose", False), ("composed", "VERB", "compose", False),
    ("associate", "VERB", "associate", False), ("associated", "VERB", "associate", False),
    ("name", "VERB", "name", False), ("named", "VERB", "name", False),
    ("class", "NOUN", "class", False), ("component", "NOUN", "component", False), ("part", "NOUN", "part", False),
    ("package", "NOUN", "package", False),
]

# ---- fixed values: test-only lexicon for the invented corpus ------------------
# Frequent invented words mapped onto the words the rules look for, so that the
# pattern joins have volume on /root/testdata.  Means nothing linguistically.
TEST_LEXICON = [
    ("ha", "VERB", "have", True), ("ed", "VERB", "contain", False), ("st", "VERB", "compose", False),
    ("nd", "VERB", "associate", False), ("re", "VERB", "name", False), ("ea", "NOUN", "class", False),
    ("nt", "NOUN", "package", False), ("er", "NOUN", "component", False), ("th", "PRON", "there", True),
    ("ti", "NUM", "one", True), ("es", "ADV", "exactly", False), ("en", "VERB", "use", False),
]

# ---- fixed values: multiplicity phrases (T6), phrase -> code -------------------
MULTIPLICITY_PHRASES = [
    ("0 or several", "0..*"),
    ("one and only one", "1..1"),
    ("one or more", "1..*"),
    ("zero or more", "0..*"),
    ("zero or one", "0..1"),
    ("at least one", "1..*"),
    ("exactly one", "1..1"),
    ("0 or more", "0..*"),
    ("0 or many", "0..*"),
    ("0 more", "0..*"),
    ("one or several", "1..*"),
    ("0 or 1", "0..1"),
    ("one and only", "1..1"),
]

# ---- fixed values: rule priorities (R18), fixed mode --------------------------
CLASS_PRIORITY = ["R1", "R2", "R8", "R9", "R5", "R6", "R3", "R4", "R7"]
REL_PRIORITY = ["R11", "R10", "R13", "R16", "R12", "R14", "R17", "R15"]
# compat mode keeps the lookup of the original: R2 and R11 are not reachable when
# another rule also hit, and R15 is in no list.
CLASS_PRIORITY_COMPAT = ["R1", "R8", "R9", "R5", "R6", "R3", "R4", "R7"]
REL_PRIORITY_COMPAT = ["R10", "R13", "R16", "R12", "R14", "R17"]

# ---- fixed values: multiplicity arrows of the diagram text sink (S7a) ---------
MULT_ARROWS = [
    ("1..1", '"1" --> "1"'),
    ("0..1", '"0" --> "1"'),
    ("0..*", '"0" --> "*"'),
    ("1..*", '"1" --> "*"'),
]


def lexicon_rows(with_test_words: bool = False) -> list[tuple]:
    return BASE_LEXICON + (TEST_LEXICON if with_test_words else [])


def lexicon_df(spark: SparkSession, with_test_words: bool = False) -> DataFrame:
    """The fixed lexicon; a constant of this module, so it carries the broadcast hint itself."""
    return F.broadcast(spark.createDataFrame(lexicon_rows(with_test_words), LEXICON_SCHEMA))


def phrases_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(p, c, len(p.split(" ")), i) for i, (p, c) in enumerate(MULTIPLICITY_PHRASES)],
        "phrase string, mult string, n_words int, phrase_rank int")


def priority_df(spark: SparkSession, compat: bool = False) -> DataFrame:
    cls = CLASS_PRIORITY_COMPAT if compat else CLASS_PRIORITY
    rel = REL_PRIORITY_COMPAT if compat else REL_PRIORITY
    rows = [(r, "class", i) for i, r in enumerate(cls)] + [(r, "rel", i) for i, r in enumerate(rel)]
    return spark.createDataFrame(rows, "rule string, kind string, priority int")


def values_sql(rows: list[tuple], columns: list[str], alias: str = "t") -> str:
    """The same constants as an inline SQL VALUES table (for SQL oracles)."""
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(columns)})"
