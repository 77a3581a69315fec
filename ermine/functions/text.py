"""Column-level string helpers (all JVM-side expressions, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_SPLIT = r"[.!?]\s+|\n+"
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capitalize(c) -> Column:
    """Python's ``str.capitalize``: first character upper, the rest lower."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def is_upper(c) -> Column:
    """Python's ``str.isupper`` for tokens: has a cased letter and no lower-case one."""
    c = col_(c)
    return (c == F.upper(c)) & (c != F.lower(c))


def lower_first(c) -> Column:
    c = col_(c)
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def conjunctive_join(words) -> Column:
    """P5: one word -> itself; else ``a,b and c`` (comma joined head, `` and `` last)."""
    w = col_(words)
    n = F.size(w)
    return (F.when(n == 0, F.lit(""))
            .when(n == 1, F.element_at(w, 1))
            .otherwise(F.concat(F.array_join(F.slice(w, 1, n - 1), ","), F.lit(" and "), F.element_at(w, -1))))


def ensure_period(c) -> Column:
    """Add a final ``.`` when the text does not end with one."""
    c = col_(c)
    return F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit(".")))
