"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_users_csv(rows: DataFrame, path: str) -> None:
    """The user export: header, every cell quoted, quotes doubled, CRLF rows."""
    (
        rows.na.fill("").write.mode("overwrite").option("header", True).option("quoteAll", True)
        .option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)
    )


def append_call_log(rows: DataFrame, path: str) -> None:
    """Append call-log rows, one folder per day.

    Rows of a day are first brought together; adaptive execution splits a busy
    day into as many tasks as its size asks for.
    """
    rows.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Write the next state of a table to a new path."""
    rows.write.mode("errorifexists").parquet(path)
