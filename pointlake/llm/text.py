"""Words as the contracts define them: maximal runs of characters other than U+0020 and U+0009-U+000D."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java regular expressions.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of ``text`` as UTF-8. ``bytes.split`` cuts at exactly those six ASCII characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def words_column(text: Column) -> Column:
    """The words of a text column as an array; null: an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name`` with as many underscores before it as no column of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
