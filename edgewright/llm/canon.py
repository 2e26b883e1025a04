"""Canonical writing of artifact names.

Two names are the same writing apart from case, white space, invisible characters, punctuation,
compatibility forms of characters and the order of facets in brackets.  A decimal point between
digits is content.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters and marks by their Unicode category that show nothing.
INVISIBLE = "[\\x{034F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{3164}\\x{FFA0}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}\\p{Cf}]"
#: Stands for a decimal point while punctuation is dropped; a private-use character.
POINT = "\ue000"


def fold(s: str) -> str:
    """NFKC and full case folding, closed under repetition."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(StringType())
def _fold_wide(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def folded(c: Column) -> Column:
    """Compatibility forms and case folded.  Only texts with characters beyond ASCII visit Python;
    for the others, which are most, lower case is the same and stays in the JVM."""
    beyond = F.when(c.rlike("[^\\x00-\\x7F]"), c)
    return F.coalesce(_fold_wide(beyond), F.lower(c))


def prepared(c: Column) -> Column:
    """Folded text without invisible characters, decimal points between digits marked."""
    seen = F.regexp_replace(folded(c), INVISIBLE, "")
    return F.regexp_replace(F.replace(seen, F.lit(POINT), F.lit("")), "(?<=\\p{Nd})\\.(?=\\p{Nd})", POINT)


def letters(c: Column) -> Column:
    """Letters, digits, marks and decimal points only."""
    return F.regexp_replace(c, f"[^\\p{{L}}\\p{{N}}\\p{{M}}{POINT}]+", "")


def parts(p: Column) -> tuple[Column, Column]:
    """Of a prepared name: the text outside brackets, and the facets inside them in sorted order."""
    inside = F.regexp_extract(p, "\\[([^\\[\\]]*)\\]", 1)
    outside = letters(F.regexp_replace(p, "\\[[^\\[\\]]*\\]", " "))
    facets = F.array_sort(F.filter(F.transform(F.split(inside, "[,;|、]"), letters), lambda x: x != ""))
    return outside, F.array_join(facets, "")


def canonical(p: Column) -> Column:
    """Canonical form of a prepared name; '' if no letter or digit is left."""
    outside, facets = parts(p)
    return F.when(p.contains("["), F.concat(outside, facets)).otherwise(letters(p))
