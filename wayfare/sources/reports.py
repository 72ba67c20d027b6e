"""Sinks; each returns what was written, read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfare import schema
from wayfare.sources.tables import new_path


def write_partitioned(df: DataFrame, by: str, path: str | None = None, file_rows: int = 5_000_000) -> DataFrame:
    """Parquet in a folder for each value; values that df does not have keep what was written before.

    Rows are rebalanced by the value: small values share a task, and a large one is split into tasks, so files, of a size that
    Spark's advisory partition size and file_rows set, grow in number and not in size.
    """
    path = path or new_path(df.sparkSession, "parquet")
    writer = df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows)
    writer.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_observed(df: DataFrame, numeric: list[str], ranges: dict[str, tuple[float, float]], order: list[str], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what was written, checks): a row for each check and its count, taken while the table is written, without a scan of its own.

    Checks: rows; rows of each numeric column that are null, NaN or infinite; values outside their range; and, from the
    schema alone, columns of the order that are missing or not at their place.
    """
    path = path or new_path(df.sparkSession, "observed")
    odd = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    checks = {"rows": F.count("*")} | {c: F.count_if(odd(c)) for c in numeric}
    checks |= {f"{c} outside {a:g}..{b:g}": F.count_if(~F.col(c).between(a, b)) for c, (a, b) in ranges.items()}
    seen = Observation("quality")
    df.observe(seen, *(x.alias(f"_{i}") for i, x in enumerate(checks.values()))).write.mode("overwrite").parquet(path)
    found = [(name, seen.get[f"_{i}"]) for i, name in enumerate(checks)]
    found += [("missing columns", len(schema.missing(df.columns, order))), ("columns out of place", len(schema.out_of_order(df.columns, order)))]
    return df.sparkSession.read.parquet(path), df.sparkSession.createDataFrame(found, "check string, n long")


def write_csv(df: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """A small report as one CSV file with a header."""
    path = path or new_path(df.sparkSession, "csv")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.csv(path, header=True, schema=schema)


def write_text(lines: DataFrame, path: str | None = None) -> DataFrame:
    """One line for each row of a single string column."""
    path = path or new_path(lines.sparkSession, "text")
    lines.coalesce(1).write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path)


def _value(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)).otherwise("N/A")


def _lines(rows: DataFrame, order: list[str], lines: list[Column]) -> DataFrame:
    """The lines of each row in order, null ones left out; reports are small, so one task sorts them."""
    numbered = rows.select(*order, F.posexplode(F.array(*lines)).alias("_n", "value")).filter("value is not null")
    return numbered.coalesce(1).sortWithinPartitions(*order, "_n").select("value")


#: Labels of a metric row's lines.
METRIC_LINES = {"ROC-AUC": "roc_auc", "PR-AUC": "pr_auc", "Brier": "brier", "Accuracy": "accuracy", "Precision": "precision_pos", "Recall": "recall_pos", "F1 (pos)": "f1_pos"}


def metric_lines(rows: DataFrame) -> DataFrame:
    """Text of a metric table: a heading and a line a metric for each row; missing values are N/A, an unasked top bucket has no line."""
    head = [F.concat_ws(" / ", F.col("context"), F.col("split")), F.concat(F.lit("Threshold: "), F.format_string("%.3f", "threshold"))]
    body = [F.concat(F.lit(f"{label}: "), _value(c)) for label, c in METRIC_LINES.items()]
    share = F.round((1 - F.col("top_bucket_quantile")) * 100).cast("int")
    top = F.when(F.col("top_bucket_quantile").isNotNull(), F.concat(F.lit("Top "), share.cast("string"), F.lit("% bucket positive rate: "), _value("top_bucket_rate")))
    return _lines(rows, ["context", "split"], [*head, *body, top])


#: Labels of a backtest's lines.
BACKTEST_LINES = {"Base rate": "base_rate", "ROC-AUC": "roc_auc", "PR-AUC": "pr_auc", "Brier": "brier", "Top bucket positive rate": "top_rate", "Share of all events in top bucket": "event_share"}


def backtest_lines(core: DataFrame) -> DataFrame:
    """Text of a backtest: a block for each task with its rows, base rate, ranking metrics, Brier score and top bucket."""
    head = [F.concat(F.lit("Task: "), F.col("task")), F.concat(F.lit("Samples: "), F.col("n").cast("string"))]
    return _lines(core, ["task"], [*head, *(F.concat(F.lit(f"{label}: "), _value(c)) for label, c in BACKTEST_LINES.items())])


def csv_round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """CSV files with a header, read with the frame's own schema."""
    path = path or new_path(df.sparkSession, "csv")
    df.write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.csv(path, header=True, schema=df.schema)
