"""Checks of rows by named conditions, counted in the pass that reads the table anyway."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ROWS = "rows"

Rules = Mapping[str, str | Column]


def broken(rule: str | Column) -> Column:
    """Whether a row breaks the rule: it is not true, so a null breaks it as well."""
    return ~F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))


def observe_checks(df: DataFrame, rules: Rules) -> tuple[DataFrame, Observation]:
    """``df`` as it is, and an observation of its ``rows`` and of how many of them break each rule.

    The numbers are there after the first action on the returned table, and cost no scan of their own.  A rule is
    a condition that good rows fulfil.
    """
    if ROWS in rules:
        raise ValueError(f"{ROWS!r} is the name of the number of rows")
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias(ROWS), *[F.count_if(broken(rule)).alias(name) for name, rule in rules.items()]), seen


def stop_at_broken(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` as it is; a row that breaks a rule stops the query that reads it."""
    for name, rule in rules.items():
        df = df.filter(F.when(broken(rule), F.raise_error(F.lit(f"a row breaks the rule {name!r}")).cast("boolean")).otherwise(True))
    return df


def broken_rows(df: DataFrame, rules: Rules) -> DataFrame:
    """``rule`` and the columns of ``df``: a row for each row and rule that it breaks, in one scan."""
    name = "rule"
    while name in df.columns:
        name = f"_{name}"
    names = F.array_compact(F.array(*[F.when(broken(rule), F.lit(key)) for key, rule in rules.items()]))
    marked = df.select(names.alias("__broken"), F.struct("*").alias("__row")).filter(F.size("__broken") > 0)
    return marked.select(F.explode("__broken").alias(name), "__row.*")
