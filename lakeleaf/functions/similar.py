"""Upper bounds of the similarity ratio in built-in functions, so that few rows reach Python.

The ratio is twice the matched characters by the characters of both texts.  No
more can match than both hold of each character, so counts of the known text's
characters bound it from above; a bound below the threshold rules a row out.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udfs as U

#: Added to bounds, against rounding.
SLACK = 1e-9


def ratio_bound(text: str, folded: Column) -> Column:
    """At least the ratio of a text to a column of folded texts; 0 where one is empty."""
    own = (U.nfc_text(text) or "").lower()
    held = lambda x: F.length(folded) - F.length(F.replace(folded, F.lit(x), F.lit("")))
    shared = sum((F.least(F.lit(n), held(x)) for x, n in Counter(own).items()), F.lit(0))
    return F.when((folded == "") | folded.isNull() | F.lit(own == ""), 0.0).otherwise(2 * shared / (F.lit(len(own)) + F.length(folded)) + SLACK)


def likely(text: str, folded: Column, least: float) -> Column:
    """Whether the ratio can reach ``least``: by the lengths first, then by the characters."""
    own = len((U.nfc_text(text) or "").lower())
    by_length = 2 * F.least(F.lit(own), F.length(folded)) >= (least - SLACK) * (F.lit(own) + F.length(folded))
    return F.when(by_length, ratio_bound(text, folded) >= least).otherwise(False)
