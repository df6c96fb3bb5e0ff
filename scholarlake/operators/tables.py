"""Structured tables: cells, their values and the evidence in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("%", "ms", "kg", "GB", "dB")


def cell_value(raw: Column) -> tuple[Column, Column, Column]:
    """(value, unit, confidence) of a cell: its first number without thousands' commas; a percent sign or a unit after it; surer if the number is all there is."""
    number = F.regexp_extract(F.regexp_replace(raw, r"(?<=\d),(?=\d{3})", ""), r"-?\d+(?:\.\d+)?", 0)
    value = F.when(number != "", number.cast("double"))
    unit = F.coalesce(*[F.when(raw.contains(u), u) for u in UNITS], F.lit(""))
    rest = F.trim(F.regexp_replace(raw, r"[-+\d.,%\s]", ""))
    confidence = F.when(value.isNull(), 0.0).when(rest == "", 0.95).when(unit != "", 0.85).otherwise(0.6)
    return value, unit, confidence


def distinct_names(names: Column) -> Column:
    """Column names made distinct: the second 'a' is a_2."""
    return F.transform(names, lambda x, i: F.when(F.size(F.filter(F.slice(names, 1, i), lambda y: y == x)) > 0, F.concat(x, F.lit("_"), (F.size(F.filter(F.slice(names, 1, i), lambda y: y == x)) + 1).cast("string"))).otherwise(x))


def cells(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, value): a row for each cell that has a value."""
    return rows.select(*keys, *columns).unpivot(list(keys), list(columns), "column", "value").filter("value is not null")


def extremes(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, max_row, max_value, min_row, min_value) of (group, row_label, value); of equals the least label."""
    top, low = F.max(F.struct("value", (-F.col("row_label")).alias("r"))), F.min(F.struct("value", F.col("row_label").alias("r")))
    g = cells.groupBy(*group).agg(top.alias("t"), low.alias("l"))
    return g.select(*group, (-F.col("t.r")).alias("max_row"), F.col("t.value").alias("max_value"), F.col("l.r").alias("min_row"), F.col("l.value").alias("min_value"))


def differences(cells: DataFrame, focus: int, reference: int) -> DataFrame:
    """(table_id, column, difference): reference less focus in each column that both rows have."""
    pick = lambda label: F.max(F.when(F.col("row_label") == label, F.col("value")))
    g = cells.filter(F.col("row_label").isin(focus, reference)).groupBy("table_id", "column").agg(pick(focus).alias("f"), pick(reference).alias("r"))
    return g.filter("f is not null and r is not null").select("table_id", "column", F.round(F.col("r") - F.col("f"), 6).alias("difference"))


def table_score(ref: Column, caption: Column, section: Column, columns: Column, rows: Column, ablation: Column, dataset: Column, confidence: Column) -> Column:
    """How well a table answers: reference 1.1, then capped shares of caption, section, columns, rows, context and confidence; rounded to 4 places."""
    one = lambda test, w: F.when(test, w).otherwise(0.0)
    cap = lambda most, x: F.least(F.lit(most), x)
    return F.round(one(ref, 1.1) + cap(0.45, caption * 0.6) + cap(0.28, section * 0.35) + cap(0.8, columns * 0.26) + cap(0.55, rows * 0.2) + one(ablation, 0.25) + one(dataset, 0.18) + cap(0.85, confidence * 0.9), 4)
