"""Connections and cursors (DB-API style) over a session: SQL and commands on keys."""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.lexer import SqlError
from brindle.session import Result, Session

_SQL = frozenset("SELECT WITH VALUES INSERT UPDATE DELETE TRUNCATE CREATE DROP ALTER".split())


class Cursor:
    def __init__(self, session: Session):
        self.session = session
        self.rowcount = -1
        self.description: list[tuple] | None = None
        self._rows: Iterator = iter(())

    def execute(self, text: str, params: list | tuple = ()) -> Cursor:
        """One SQL statement, or one command with arguments in shell quoting; ``?`` takes parameters in turn."""
        word = text.split(None, 1)[0].upper() if text.strip() else ""
        if word == "SQL":
            text = text.split(None, 1)[1]
            word = text.split(None, 1)[0].upper()
        if (word in _SQL and not re.fullmatch(r"(?i)\s*DELETE\s+(?!FROM\b).*", text, re.DOTALL)) or text.lstrip().startswith("("):
            return self._take(self.session.execute(text, list(params)))
        given = iter(params)
        parts = [next(given) if p == "?" else p for p in shlex.split(text)]
        return self._take(command(self.session, *map(str, parts)))

    def _take(self, result) -> Cursor:
        self.description, self.rowcount, self._rows = None, -1, iter(())
        if isinstance(result, Result):
            self.rowcount = result.count
            result = result.rows
        if isinstance(result, DataFrame):
            self.description = [(n, t, None, None, None, None, None) for n, t in result.dtypes]
            self._rows = (tuple(r) for r in result.toLocalIterator())
        elif isinstance(result, list):
            self._rows = iter([(x,) for x in result])
        elif result is not None:
            self._rows = iter([(result,)])
        return self

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int = 1) -> list[tuple]:
        return [r for _, r in zip(range(size), self._rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self) -> Iterator:
        return self._rows

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, session: Session):
        self.session = session

    def cursor(self) -> Cursor:
        return Cursor(self.session)

    def commit(self) -> None:
        if self.session.transaction is not None:
            self.session.execute("COMMIT")

    def rollback(self) -> None:
        if self.session.transaction is not None:
            self.session.execute("ROLLBACK")

    def close(self) -> None:
        self.rollback()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.commit() if kind is None else self.rollback()


def connect(spark: SparkSession, root: str | None = None, isolation: str = "serializable") -> Connection:
    return Connection(Session(spark, root, isolation))


def command(session: Session, name: str, *args: str):
    """One command on keys, indexes, transactions or the store, by its upper-case name."""
    kv = session.kv
    count = lambda a: int(a[0]) if a else None
    table = {
        "PING": lambda: "PONG",
        "GET": kv.get,
        "SET": lambda k, v: kv.set(k, v) or "OK",
        "DELETE": kv.delete,
        "KEYS": kv.keys,
        "JSON.SET": lambda k, v: kv.json_set(k, v) or "OK",
        "JSON.GET": kv.json_get,
        "JSON.DEL": kv.json_del,
        "LPUSH": kv.lpush,
        "RPUSH": kv.rpush,
        "LPOP": lambda k, *n: kv.lpop(k, count(n)),
        "RPOP": lambda k, *n: kv.rpop(k, count(n)),
        "LLEN": kv.llen,
        "LRANGE": lambda k, a, b: kv.lrange(k, int(a), int(b)),
        "SADD": kv.sadd,
        "SREM": kv.srem,
        "SMEMBERS": kv.smembers,
        "SCARD": kv.scard,
        "SISMEMBER": kv.sismember,
        "FLUSHDB": lambda: session.flush() or "OK",
        "WIPEDB": lambda: session.flush() or "OK",
        "SAVE": lambda: "OK",  # every commit is on disk
        "MEMUSAGE": session.size,
        "VACUUM": session.vacuum,
        "IDX.CREATE": session.create_path_index,
        "CREATEINDEX": lambda prefix, *on: session.create_path_index(f"{prefix.rstrip('*:')}_{on[-1]}", prefix, on[-1]),
        "IDX.DROP": session.drop_path_index,
        "IDX.LIST": lambda: json.dumps(session.path_indexes()),
    }
    upper = name.upper()
    if upper in ("BEGIN", "COMMIT", "ROLLBACK"):
        return session.execute(upper).rows or "OK"
    if upper in ("SAVEPOINT", "ROLLBACK_TO_SAVEPOINT", "RELEASE_SAVEPOINT"):
        session.execute(f"{upper.replace('_', ' ')} {args[0]}")
        return "OK"
    if upper not in table:
        raise SqlError(f"unknown command {name!r}")
    try:
        return table[upper](*args)
    except TypeError as e:
        raise SqlError(f"wrong number of arguments for {upper}") from e
