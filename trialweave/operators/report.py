"""Validation findings as a table: one row per finding, row and variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.table import ROW, Table

#: Severities, least first.
SEVERITIES = ("NOTICE", "WARNING", "ERROR", "REJECT")


def findings(t: Table, rule: str, condition: Column, variables: list[str], severity: str = "ERROR", scope: str = "RECORD") -> DataFrame:
    """(rule, dataset, kind, severity, scope, row, variable, value) of the rows that meet the condition; rows from 1."""
    values = F.array(*[F.struct(F.lit(v).alias("variable"), t.col(v).cast("string").alias("value")) for v in variables])
    return t.df.where(condition).select(F.lit(rule).alias("rule"), F.lit(t.name).alias("dataset"), F.lit("DATA").alias("kind"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), (F.col(ROW) + 1).alias("row"), F.explode(values).alias("x")).select("rule", "dataset", "kind", "severity", "scope", "row", "x.variable", "x.value")


def summary(found: DataFrame) -> DataFrame:
    """Findings per rule, dataset and severity, with the first row."""
    return found.groupBy("rule", "dataset", "severity").agg(F.count_distinct("row").alias("n"), F.min("row").alias("first_row"), F.collect_set("variable").alias("variables"))
