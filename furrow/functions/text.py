"""Text functions. All are built from JVM-side expressions; whole texts, never prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.nulls import _col

WORD_OR_GAP = r"([\p{L}\p{N}']+|[^\p{L}\p{N}']+)"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TOKEN = r"(?U)\b\w\w+\b"


def replace_first(c: Column | str, pattern: str, replacement: str) -> Column:
    """Replace the first match of ``pattern`` only (``regexp_replace`` replaces all)."""
    return F.regexp_replace(_col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def strip_literal(c: Column | str, text: str) -> Column:
    """Remove every occurrence of a literal."""
    return F.replace(_col(c), F.lit(text), F.lit(""))


def remove_all(c: Column | str, pattern: str) -> Column:
    """Remove every match of a regex."""
    return F.regexp_replace(_col(c), pattern, "")


def before(c: Column | str, delimiter: str) -> Column:
    """Text before the first delimiter; the whole text when there is none."""
    return F.substring_index(_col(c), delimiter, 1)


def split_values(c: Column | str, delimiter: str = ",") -> Column:
    """Delimited list to array, order kept. An empty string gives one empty item."""
    return F.split(_col(c), rf"\Q{delimiter}\E")


def leading_words(c: Column | str) -> Column:
    """Leading run of ASCII letters and blanks."""
    return F.regexp_extract(_col(c), "^[a-zA-Z ]*", 0)


def title_words(c: Column | str) -> Column:
    """Title case at every word start, so ``income/expenditure`` becomes ``Income/Expenditure``."""
    pieces = F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_OR_GAP), F.lit(1))
    raised = F.transform(pieces, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))
    return F.array_join(raised, "")


def trim_all(c: Column | str) -> Column:
    """Trim any white space at both ends, tabs and line breaks included."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def paste(*cols: Column | str, sep: str = " ", na: str = "text") -> Column:
    """Concatenate. NULL becomes the text ``NA`` (``na='text'``) or makes the result NULL (``na='null'``)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        c = _col(c).cast("string")
        parts += ([F.lit(sep)] if i else []) + [F.coalesce(c, F.lit("NA")) if na == "text" else c]
    return F.concat(*parts)


def wrap(c: Column | str, width: int) -> Column:
    """Greedy word wrap to lines of at most ``width``; a longer word gets its own line."""
    words = F.split(trim_all(c), r"\s+")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(acc, word):
        size = F.length(word)
        fits = acc["used"] + size + 1 <= width
        text = (
            F.when(acc["used"] == 0, word)
            .when(fits, F.concat(acc["text"], F.lit(" "), word))
            .otherwise(F.concat(acc["text"], F.lit("\n"), word))
        )
        used = F.when((acc["used"] > 0) & fits, acc["used"] + size + 1).otherwise(size)
        return F.struct(text.alias("text"), used.alias("used"))

    return F.aggregate(words, start, step, lambda acc: acc["text"])


def to_int(c: Column | str) -> Column:
    """Text to integer: fractions are cut, anything that is no decimal number gives NULL."""
    c = _col(c).cast("string")
    return F.when(c.rlike(NUMBER), c.try_cast("double").try_cast("int"))


def matches_ci(c: Column | str, pattern: str) -> Column:
    """Case-insensitive regex search."""
    return _col(c).rlike(f"(?i)(?:{pattern})")


def min_length(c: Column | str, n: int) -> Column:
    """Strictly longer than ``n`` code points; NULL is not."""
    return F.coalesce(F.length(_col(c)) > n, F.lit(False))


def tokens(c: Column | str) -> Column:
    """Lower-cased words of two or more word characters, accented letters included."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))
