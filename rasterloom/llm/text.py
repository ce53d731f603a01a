"""Word and size expressions that several operators share; all of them are native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, and its runs.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; none for a null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def uniform(*of: Column) -> Column:
    """A double in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def bounded(rows: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """All rows if there are at most n, else about n of them, chosen by a hash of their ids. rows are counted."""
    total = rows.count()
    return rows if total <= n else rows.where(uniform(F.col(id_col), F.lit("sample")) < n / total)
