"""Type names of the dialect and the guarded casts they stand for, as Spark SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from brindle.plans.lexer import SqlError, quote

_PLAIN = {
    "SMALLINT": "SMALLINT", "INTEGER": "INT", "INT": "INT", "BIGINT": "BIGINT", "REAL": "FLOAT",
    "DOUBLE PRECISION": "DOUBLE", "DOUBLE": "DOUBLE", "FLOAT": "DOUBLE", "TEXT": "STRING", "STRING": "STRING",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP",
    "DATE": "DATE", "TIME": "STRING", "BYTEA": "BINARY", "UUID": "STRING", "JSONB": "STRING", "JSON": "STRING",
}
UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


@dataclass(frozen=True)
class Type:
    """A declared type: base name, parameters, and the element's type for arrays."""

    base: str
    params: tuple[int, ...] = ()
    element: Type | None = None

    @property
    def text(self) -> str:
        if self.element:
            return self.element.text + "[]"
        return self.base + (f"({','.join(map(str, self.params))})" if self.params else "")

    @property
    def spark(self) -> str:
        if self.element:
            return f"ARRAY<{self.element.spark}>"
        if self.base in ("NUMERIC", "DECIMAL"):
            precision, scale = (*self.params, 0)[:2] if self.params else (0, 0)
            return f"DECIMAL({precision},{scale})" if self.params else "DOUBLE"
        if self.base in ("VARCHAR", "CHAR"):
            return "STRING"
        return _PLAIN[self.base]


def parse_type(text: str) -> Type:
    text = re.sub(r"\s+", " ", text.strip().upper())
    if text.endswith("[]"):
        return Type("ARRAY", element=parse_type(text[:-2]))
    m = re.fullmatch(r"([A-Z ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", text)
    base = m and m[1]
    if not m or base not in {*_PLAIN, "NUMERIC", "DECIMAL", "VARCHAR", "CHAR"}:
        raise SqlError(f"unknown type {text}")
    return Type(base, tuple(int(x) for x in m.groups()[1:] if x))


def _checked(test: str, value: str, what: str) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE raise_error({quote(what)}) END"


def cast(e: str, kind: Type) -> str:
    """e cast to the type: null stays null, and a value that doesn't fit raises."""
    s = f"CAST({e} AS STRING)"
    if kind.element:
        items = f"split(regexp_replace({s}, '^\\\\s*[\\\\[{{]|[\\\\]}}]\\\\s*$', ''), ',')"
        inner = cast("regexp_replace(trim(x), '^\"|\"$', '')", kind.element)
        return f"CASE WHEN {e} IS NULL THEN NULL WHEN {s} RLIKE '^\\\\s*[\\\\[{{]\\\\s*[\\\\]}}]\\\\s*$' THEN CAST(array() AS {kind.spark}) ELSE transform({items}, x -> {inner}) END"
    if kind.base == "VARCHAR" and kind.params:
        return f"CASE WHEN {e} IS NULL THEN NULL ELSE {_checked(f'octet_length({s}) <= {kind.params[0]}', s, f'value too long for {kind.text}')} END"
    if kind.base == "CHAR":
        return f"rpad({s}, {kind.params[0] if kind.params else 1}, ' ')"
    if kind.base in ("BOOLEAN", "BOOL"):
        low = f"lower(trim({s}))"
        return (
            f"CASE WHEN {e} IS NULL THEN NULL WHEN {low} IN ('true','t','1','y','yes','1.0') THEN true "
            f"WHEN {low} IN ('false','f','0','n','no','0.0') THEN false ELSE raise_error({quote('not a boolean')}) END"
        )
    if kind.base in ("SMALLINT", "INTEGER", "INT", "BIGINT"):
        return f"CAST({e} AS {kind.spark})"
    if kind.base == "UUID":
        return f"CASE WHEN {e} IS NULL THEN NULL ELSE {_checked(f'lower({s}) RLIKE {quote(UUID)}', f'lower({s})', 'not a uuid')} END"
    if kind.base == "BYTEA":
        return f"CASE WHEN {e} IS NULL THEN NULL ELSE coalesce(try_to_binary(regexp_replace({s}, '^\\\\\\\\x', ''), 'hex'), raise_error({quote('not hex text')})) END"
    if kind.base == "TIME":
        return f"CASE WHEN {e} IS NULL THEN NULL ELSE {_checked(f'{s} RLIKE {quote("^([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?$")}', s, 'not a time')} END"
    if kind.base in ("JSON", "JSONB"):
        return f"CASE WHEN {e} IS NULL THEN NULL ELSE coalesce(to_json(try_parse_json({s})), raise_error({quote('not JSON')})) END"
    return f"CAST({e} AS {kind.spark})"
