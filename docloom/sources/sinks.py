"""Where results go: CSV exports, Markdown tables, logs and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def append_log(df: DataFrame, path: str, clips: dict[str, int]) -> None:
    """Append rows of a log, long texts clipped."""
    df.withColumns({c: F.substring(c, 1, n) for c, n in clips.items()}).write.mode("append").parquet(path)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def markdown_lines(df: DataFrame) -> DataFrame:
    """(line): each row as a line of a Markdown table."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
