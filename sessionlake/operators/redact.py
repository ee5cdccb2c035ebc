"""Redaction as a job over a table of texts, with counts, and the admission of messages into a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .classify import looks_injected


def redact_column(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows with the column redacted and `redactions`, their number in the row."""
    return rows.withColumn("redacted", T.redact(column)).withColumn(column, F.col("redacted.text")).withColumn("redactions", F.coalesce("redacted.n", F.lit(0))).drop("redacted")


def redaction_counts(redacted: DataFrame, *by: str) -> DataFrame:
    return redacted.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("redactions").alias("redactions"))


def admit_messages(rows: DataFrame, chars: int = 4096) -> DataFrame:
    """Messages fit for a report: nothing injected, redacted, trimmed, the last `chars` characters; empty ones go."""
    clean = redact_column(rows.filter(~looks_injected("text")))
    return clean.withColumn("text", T.truncate_tail(T.strip("text"), chars)).filter("text <> ''")


def admit_operations(rows: DataFrame, chars: int = 200, column: str = "text") -> DataFrame:
    """Operations fit for a report: the first line of the redacted text, at most `chars` characters."""
    clean = redact_column(rows.filter(~looks_injected(column)), column)
    return clean.withColumn(column, T.truncate_chars(T.strip(T.first_line(column)), chars)).filter(F.col(column) != "")
