"""Batch command files as rows."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPY_VERBS = ("cp", "copy", "sync")


def tokens(line: str) -> list[str] | None:
    """The words of a line by shell rules; null where quotes do not close."""
    try:
        return shlex.split(line)
    except ValueError:
        return None


def parse_commands(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line_no, verb, arguments, status) of command lines; blank and ``#`` lines are left out.

    Copy verbs become ``copy``; nested ``run`` is rejected; lines that cannot be split are bad.
    """

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(tokens)

    rows = lines.where(~F.trim(value).startswith("#") & (F.trim(value) != "")).withColumn("words", split(F.col(value)))
    verb = F.get("words", F.lit(0))
    status = F.when(F.col("words").isNull(), "bad").when(verb == "run", "rejected").otherwise("ok")
    return rows.select("line_no", F.when(verb.isin(*COPY_VERBS), "copy").otherwise(verb).alias("verb"), F.slice("words", 2, 10_000).alias("arguments"), status.alias("status"))
