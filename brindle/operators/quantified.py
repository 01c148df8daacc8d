"""Comparisons with ANY and ALL of a subquery in three-valued logic, as Spark SQL.

Each is a CASE over scalar aggregates of the subquery (which Spark merges to one scan), so that no
row of the outer side is compared with each row of the inner.
"""

from __future__ import annotations

_ANY = {">": "{a} > {mn}", ">=": "{a} >= {mn}", "<": "{a} < {mx}", "<=": "{a} <= {mx}", "<>": "({a} <> {mn} OR {a} <> {mx})"}
_ALL = {">": "{a} > {mx}", ">=": "{a} >= {mx}", "<": "{a} < {mn}", "<=": "{a} <= {mn}", "=": "({a} = {mn} AND {a} = {mx})"}


def quantified(a: str, op: str, word: str, subquery: str) -> str:
    """``a op word (subquery)``; op is one of = <> < <= > >=, word ANY or ALL; the subquery has one column."""
    of = lambda f: f"(SELECT {f} FROM ({subquery}) AS quantified(c))"
    values = {"a": a, "mn": of("min(c)"), "mx": of("max(c)")}
    empty, nulls = f"{of('count(*)')} = 0", f"{of('count(*) - count(c)')} > 0"
    if word == "ANY":
        hit = f"{a} IN ({subquery})" if op == "=" else _ANY[op].format(**values)
        return f"(CASE WHEN {empty} THEN false WHEN {a} IS NULL THEN NULL WHEN {hit} THEN true WHEN {nulls} THEN NULL ELSE false END)"
    if op == "<>":
        miss = f"{a} IN ({subquery})"
    else:
        miss = f"NOT ({_ALL[op].format(**values)})"
    return f"(CASE WHEN {empty} THEN true WHEN {a} IS NULL THEN NULL WHEN {miss} THEN false WHEN {nulls} THEN NULL ELSE true END)"
