"""The word rule that several operators share: ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators of words, fixed by the contract.
SEPARATORS = " \t\n\x0b\x0c\r"
_RUN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _RUN), "")


def word_chars_of(text: Column) -> Column:
    """Code points within words."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SEPARATORS, "")).cast("long")


def word_count_of(text: Column) -> Column:
    """Number of words, without keeping them."""
    return F.size(words_of(text)).cast("long")
