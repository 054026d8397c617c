"""What the operators share: the word rule, staged tables and table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_dir, ship, staged

__all__ = ["SPACES", "ascii_lower", "shared_dir", "staged", "table", "words"]

#: Characters between words: space and \\t \\n \\v \\f \\r.  ``bytes.split()`` uses just these.
SPACES = "[\\x20\\x09-\\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def words(c: Column) -> Column:
    """The words of a text; an empty text gives one empty string."""
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.split(trimmed, SPACES + "+")
