"""Scalar functions of the dialect as Spark SQL expressions."""

from __future__ import annotations

from brindle.plans.lexer import SqlError

AGGREGATES = frozenset(["COUNT", "SUM", "AVG", "MIN", "MAX"])


def _arity(name: str, args: list[str], least: int, most: int) -> None:
    if not least <= len(args) <= most:
        raise SqlError(f"{name} takes {least} to {most} arguments")


def call(name: str, args: list[str]) -> str:
    """The Spark expression of one call; names that the dialect does not define go to Spark as they are."""
    upper = name.upper()
    if upper in ("LOWER", "UPPER", "LENGTH", "TRIM", "ABS", "CEIL", "FLOOR", "IS_NULL", "IS_NOT_NULL"):
        _arity(upper, args, 1, 1)
        x = args[0]
        return {
            "LOWER": f"lower({x})",
            "UPPER": f"upper({x})",
            "LENGTH": f"char_length({x})",
            "TRIM": f"regexp_replace({x}, '(?U)^\\\\s+|\\\\s+$', '')",
            "ABS": f"abs(CAST({x} AS DOUBLE))",
            "CEIL": f"CAST(ceil(CAST({x} AS DOUBLE)) AS DOUBLE)",
            "FLOOR": f"CAST(floor(CAST({x} AS DOUBLE)) AS DOUBLE)",
            "IS_NULL": f"({x} IS NULL)",
            "IS_NOT_NULL": f"({x} IS NOT NULL)",
        }[upper]
    if upper == "ROUND":
        _arity(upper, args, 1, 2)
        return f"round(CAST({args[0]} AS DOUBLE){''.join(', ' + a for a in args[1:])})"
    if upper == "SUBSTRING":
        _arity(upper, args, 2, 3)
        start = f"greatest(CAST({args[1]} AS INT), 1)"
        return f"substring({', '.join([args[0], start, *args[2:]])})"
    if upper == "NOW":
        _arity(upper, args, 0, 0)
        return "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")"
    if upper == "DATE_PART":
        _arity(upper, args, 2, 2)
        return f"CAST(floor(date_part({args[0]}, TRY_CAST({args[1]} AS TIMESTAMP))) AS BIGINT)"
    return f"{name}({', '.join(args)})"
