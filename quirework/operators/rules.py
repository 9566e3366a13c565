"""What users add to the checks: transformers, filters, rules, field types and schema overlays.

All of them are functions of columns, so they stay inside the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OnColumn = Callable[[Column], Column]


class Rules:
    """Registered steps for one text column, applied in the order of registration."""

    def __init__(self) -> None:
        self.transformers: list[OnColumn] = []
        self.filters: list[OnColumn] = []
        self.checks: list[tuple[Column, str]] = []

    def add_transformer(self, function: OnColumn) -> Rules:
        self.transformers.append(function)
        return self

    def add_filter(self, predicate: OnColumn) -> Rules:
        self.filters.append(predicate)
        return self

    def add_check(self, rule: Column, message: str) -> Rules:
        self.checks.append((rule, message))
        return self

    def applied(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``column`` transformed; rows for which a filter is false or null are left out.

        Filters see the transformed text.  Without steps ``df`` is unchanged.
        """
        text = F.col(column)
        for function in self.transformers:
            text = function(text)
        out = df.withColumn(column, text) if self.transformers else df
        for predicate in self.filters:
            out = out.where(predicate(F.col(column)))
        return out

    def violated(self) -> Column:
        """The messages of the rules that are not true of a row, a null result included; empty if all hold."""
        if not self.checks:
            return F.array().cast("array<string>")
        messages = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), message) for rule, message in self.checks])
        return F.array_compact(messages)


def field_status(fields: dict[str, tuple[Column, str]]) -> Column:
    """``missing:<name>`` or ``type:<name>`` of the first field that is null or does not read as its type, else ``ok``.

    ``fields`` gives value and type of each name; missing ones are named before wrong ones.
    """
    out = F.when(F.lit(False), "")
    for name, (value, _) in fields.items():
        out = out.when(value.isNull(), f"missing:{name}")
    for name, (value, kind) in fields.items():
        out = out.when(value.try_cast(kind).isNull(), f"type:{name}")
    return out.otherwise("ok")


def overlay(base: T.StructType, custom: dict[str, str], tenant: str | None = None) -> T.StructType:
    """``base`` with the fields of ``custom`` (name to type) in place of equal names or behind them, and the tenant's field last.

    Names are equal whatever their case, as in Spark.
    """
    given = {n.lower(): (n, kind) for n, kind in custom.items()}
    if tenant:
        given[tenant.lower()] = (tenant, "string")
    out = [T.StructField(f.name, T.DataType.fromDDL(given.pop(f.name.lower())[1]) if f.name.lower() in given else f.dataType) for f in base.fields]
    return T.StructType(out + [T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in given.values()])


def schema_problems(schema: T.StructType, required: dict[str, str]) -> list[str]:
    """What ``schema`` lacks of the ``required`` names and types, in their order; empty if nothing."""
    have = {f.name.lower(): f.dataType for f in schema.fields}
    out = []
    for name, kind in required.items():
        found = have.get(name.lower())
        if found is None:
            out.append(f"missing: {name}")
        elif found != T.DataType.fromDDL(kind):
            out.append(f"type: {name} is {found.simpleString()}, not {kind}")
    return out


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` in its order: values that do not read as the type and absent columns are null."""
    have = {c.lower() for c in df.columns}
    cell = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
    return df.select(*[cell(f).alias(f.name) for f in schema.fields])


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, filled, nulls, distinct_values, least, greatest)`` of columns read as text.

    Equal values are counted once per task before the shuffle, so a value that a
    third of all rows share is no hot group.  An empty table has a row of zeros and nulls.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))
    none = df.sparkSession.createDataFrame([(c, None, 0) for c in columns], "column string, value string, n long")
    return counts.unionByName(none).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )
