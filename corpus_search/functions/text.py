"""Column expressions over text. All native (JVM-side), usable in select/filter/agg."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace as a regex class. The SQL oracles and the Python
# helpers use the same class so that every engine splits text identically.
WHITESPACE = "[\\t\\n\\x0B\\f\\r ]"
WHITESPACE_RUN = WHITESPACE + "+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading/trailing ASCII whitespace (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(_col(c), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_blank(c) -> Column:
    return F.coalesce(strip(c) == F.lit(""), F.lit(True))


def tokens(c) -> Column:
    """Lower-cased whitespace tokens, empty strings removed."""
    return F.array_remove(F.split(F.lower(_col(c)), WHITESPACE_RUN), "")


def collapse_whitespace(c) -> Column:
    return strip(F.regexp_replace(_col(c), WHITESPACE_RUN, " "))


def n_chars(c) -> Column:
    """Length in code points, as BIGINT."""
    return F.length(_col(c)).cast("bigint")
