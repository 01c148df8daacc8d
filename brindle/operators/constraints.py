"""Constraints as queries for the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.plans.lexer import SqlError


class ConstraintError(SqlError):
    """Rows that a constraint forbids."""


def same(left: str, right: str, columns: list[str], others: list[str] | None = None):
    return [F.col(f"{left}.`{a}`") == F.col(f"{right}.`{b}`") for a, b in zip(columns, others or columns, strict=True)]


def not_null(rows: DataFrame, column: str) -> None:
    if not rows.where(F.col(f"`{column}`").isNull()).isEmpty():
        raise ConstraintError(f"NOT NULL constraint failed for column '{column}'")


def check(rows: DataFrame, name: str, test: str) -> None:
    if not rows.where(f"NOT coalesce(({test}), false)").isEmpty():
        raise ConstraintError(f"CHECK constraint '{name}' failed")


def unique(rows: DataFrame, columns: list[str], name: str, existing: DataFrame | None = None) -> None:
    """Rows with equal keys (null keys never are) among rows, or between rows and existing, which is only looked up."""
    keys = rows.select(*[f"`{c}`" for c in columns]).dropna()
    bad = not keys.groupBy(*[f"`{c}`" for c in columns]).count().where("count > 1").isEmpty()
    if not bad and existing is not None:
        bad = not keys.alias("n").join(existing.alias("o"), same("n", "o", columns), "left_semi").isEmpty()
    if bad:
        raise ConstraintError(f"UNIQUE constraint '{name}' failed on {', '.join(columns)}")


def references(rows: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], name: str) -> None:
    keys = rows.select(*[f"`{c}`" for c in columns]).dropna()
    if not keys.alias("c").join(parent.alias("p"), same("c", "p", columns, parent_columns), "left_anti").isEmpty():
        raise ConstraintError(f"FOREIGN KEY constraint '{name}' failed on {', '.join(columns)}")
