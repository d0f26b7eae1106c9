"""Words of the contracts that count letters and digits, native from end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.shared import LOWER, UPPER

#: What lies between words: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased, nothing else; words of ASCII alone take ``lower``, which costs a tenth of ``translate``."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_list(text: Column) -> Column:
    """Lower-cased words of a text in their order; null and empty texts have none.

    Texts are split at what lies between words, which is four times as fast as extracting the words.
    """
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), ""), ascii_lower)


def with_text_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_k1, _k2``, 128 bits that stand for the text (null as empty)."""
    held = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_k1": F.xxhash64(held), "_k2": F.xxhash64(F.lit(1), held)})


def shifted(words: Column, by: int) -> Column:
    """The list without its first ``by`` entries."""
    return F.slice(words, by + 1, F.size(words))
