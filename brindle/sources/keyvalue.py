"""Keys with values of a kind: bytes, JSON, lists and sets, kept as one keyed table.

A command is one small change of the table: rows of other keys stay in their folders' place, and the
changed rows are added; reading takes the newest row of each key.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.plans.lexer import SqlError
from brindle.sources import files

TABLE = "__kv"
DEFINITION = {
    "columns": [{"name": n, "type": t, "nullable": True, "default": None} for n, t in (("key", "TEXT"), ("seq", "BIGINT"), ("kind", "TEXT"), ("value", "TEXT"), ("items", "TEXT[]"))],
    "constraints": [],
    "folders": [],
}
#: Folders of changes beyond which a change rewrites the table.
MERGE_AT = 32


class WrongType(SqlError):
    def __init__(self):
        super().__init__("WRONGTYPE Operation against a key holding the wrong kind of value")


def glob_pattern(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


class KeyValue:
    """The commands; each runs in the session's open transaction or in one of its own."""

    def __init__(self, session):
        self.session = session

    # The table

    def _rows(self) -> DataFrame:
        """The live rows: the newest of each key, without deleted keys."""
        s = self.session
        if TABLE not in s.tables:
            s.tables[TABLE] = dict(DEFINITION)
        rows = s.frame(TABLE)
        if len(s.tables[TABLE]["folders"]) > 1:
            newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
            rows = rows.withColumn("n", newest).where("n = 1").drop("n")
        return rows.where("kind is not null")

    def _get(self, key: str):
        row = self._history(key)
        return row if row is not None and row["kind"] is not None else None

    def _history(self, key: str):
        s = self.session
        if TABLE not in s.tables:
            return None
        found = s.frame(TABLE).where(F.col("key") == key).orderBy(F.desc("seq")).limit(1).collect()
        return found[0].asDict() if found else None

    def _put(self, changes: list[tuple]) -> None:
        """Add rows (key, kind, value, items); kind None deletes."""
        s = self.session
        if TABLE not in s.tables:
            s.tables[TABLE] = dict(DEFINITION)
        table = s.tables[TABLE]
        seq = table.get("seq", 0)
        rows = [(k, seq + i, kind, value, items) for i, (k, kind, value, items) in enumerate(changes, 1)]
        new = s.spark.createDataFrame(rows, s.schema(table))
        if len(table["folders"]) >= MERGE_AT:
            new = self._rows().join(new.select("key"), "key", "left_anti").unionByName(new.where("kind is not null"))
            folders = [s.store.write(new)]
        else:
            folders = [*table["folders"], s.store.write(new.coalesce(1))]
        s.tables[TABLE] = {**table, "folders": folders, "seq": seq + len(changes)}

    def _kind(self, row, kind: str) -> list[str]:
        """The items of a list or set; a missing key has none."""
        if row is None:
            return []
        if row["kind"] != kind:
            raise WrongType()
        return list(row["items"] or [])

    def _in(self, action: Callable):
        return self.session.within(action)

    # Bytes

    def get(self, key: str) -> str | None:
        def action():
            row = self._get(key)
            if row is not None and row["kind"] not in ("bytes", "json"):
                raise WrongType()
            return row and row["value"]

        return self._in(action)

    def set(self, key: str, value: str) -> None:
        self._in(lambda: self._put([(key, "bytes", value, None)]))

    def delete(self, *keys: str) -> int:
        def action():
            live = [r.key for r in self._rows().where(F.col("key").isin(list(keys))).select("key").collect()]
            if live:
                self._put([(k, None, None, None) for k in live])
            return len(live)

        return self._in(action)

    def keys(self, pattern: str = "*") -> DataFrame:
        return self._in(lambda: self._rows().where(F.col("key").rlike(f"(?s)^{glob_pattern(pattern)}$")).select("key"))

    # JSON

    def _path(self, key: str) -> tuple[str, list[str]]:
        name, *path = key.split(".")
        return name, path

    def _json(self, key: str):
        row = self._get(key)
        if row is None:
            return None
        if row["kind"] != "json":
            raise WrongType()
        return json.loads(row["value"])

    def json_set(self, key: str, value: str) -> None:
        def action():
            name, path = self._path(key)
            new = json.loads(value)
            if path:
                doc = self._json(name)
                doc = doc if isinstance(doc, dict) else {}
                at = doc
                for step in path[:-1]:
                    at[step] = at.get(step) if isinstance(at.get(step), dict) else {}
                    at = at[step]
                at[path[-1]] = new
                new = doc
            self._put([(name, "json", json.dumps(new), None)])

        self._in(action)

    def json_get(self, key: str) -> str | None:
        def action():
            name, path = self._path(key)
            at = self._json(name)
            for step in path:
                at = at[int(step)] if isinstance(at, list) and step.isdigit() and int(step) < len(at) else at.get(step) if isinstance(at, dict) else None
            return None if at is None else json.dumps(at)

        return self._in(action)

    def json_del(self, key: str) -> int:
        def action():
            name, path = self._path(key)
            doc = at = self._json(name)
            if doc is None:
                return 0
            if not path:
                self._put([(name, None, None, None)])
                return 1
            for step in path[:-1]:
                at = at.get(step) if isinstance(at, dict) else None
            if not isinstance(at, dict) or path[-1] not in at:
                return 0
            del at[path[-1]]
            self._put([(name, "json", json.dumps(doc), None)])
            return 1

        return self._in(action)

    # Lists

    def _push(self, key: str, values: tuple[str, ...], left: bool) -> int:
        def action():
            items = self._kind(self._get(key), "list")
            items = [*reversed(values), *items] if left else [*items, *values]
            self._put([(key, "list", None, items)])
            return len(items)

        return self._in(action)

    def lpush(self, key: str, *values: str) -> int:
        return self._push(key, values, True)

    def rpush(self, key: str, *values: str) -> int:
        return self._push(key, values, False)

    def _pop(self, key: str, n: int | None, left: bool):
        def action():
            items = self._kind(self._get(key), "list")
            if not items:
                return None if n is None else []
            count = 1 if n is None else min(n, len(items))
            out = items[:count] if left else items[::-1][:count]
            rest = items[count:] if left else items[: len(items) - count]
            self._put([(key, "list" if rest else None, None, rest or None)])
            return out[0] if n is None else out

        return self._in(action)

    def lpop(self, key: str, n: int | None = None):
        return self._pop(key, n, True)

    def rpop(self, key: str, n: int | None = None):
        return self._pop(key, n, False)

    def llen(self, key: str) -> int:
        return self._in(lambda: len(self._kind(self._get(key), "list")))

    def lrange(self, key: str, start: int, stop: int) -> list[str]:
        def action():
            items = self._kind(self._get(key), "list")
            first = max(0, start + len(items) if start < 0 else start)
            last = stop + len(items) if stop < 0 else stop
            return items[first : last + 1]

        return self._in(action)

    # Sets

    def sadd(self, key: str, *members: str) -> int:
        def action():
            items = self._kind(self._get(key), "set")
            new = [m for m in dict.fromkeys(members) if m not in items]
            if new:
                self._put([(key, "set", None, [*items, *new])])
            return len(new)

        return self._in(action)

    def srem(self, key: str, *members: str) -> int:
        def action():
            items = self._kind(self._get(key), "set")
            rest = [i for i in items if i not in members]
            if len(rest) < len(items):
                self._put([(key, "set" if rest else None, None, rest or None)])
            return len(items) - len(rest)

        return self._in(action)

    def smembers(self, key: str) -> list[str]:
        return self._in(lambda: sorted(self._kind(self._get(key), "set")))

    def scard(self, key: str) -> int:
        return self._in(lambda: len(self._kind(self._get(key), "set")))

    def sismember(self, key: str, member: str) -> int:
        return self._in(lambda: int(member in self._kind(self._get(key), "set")))

    # Many keys at once: a table of keys and values in, a table of replies out

    def rows(self, pattern: str = "*") -> DataFrame:
        """(key, kind, value, items) of all live keys that match."""
        return self._in(lambda: self._rows().where(F.col("key").rlike(f"(?s)^{glob_pattern(pattern)}$")).select("key", "kind", "value", "items"))

    def _change(self, given: DataFrame, kind: str, after: Column, reply: Column) -> DataFrame:
        """Apply one command to every key of given (key, values; each key once), and return (key, reply).

        after and reply are columns of ``items`` (those of the key now, empty if it is new) and ``values``. A key left
        without items is deleted.
        """

        def action() -> DataFrame:
            s = self.session
            if given.groupBy("key").count().where("count > 1 or key is null").limit(1).count():
                raise SqlError("a key is null or given twice")
            now = self._rows().select("key", F.col("kind").alias("now"), "items")
            met = files.written(given.select("key", "values").join(now, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))
            if not met.where(F.col("now") != kind).isEmpty():
                raise WrongType()
            table = s.tables[TABLE]
            seq = table.get("seq", 0) + 1
            changed = met.withColumn("reply", reply).withColumn("items", after)
            left = F.size("items") > 0
            new = changed.select(
                "key", F.lit(seq).cast("long").alias("seq"), F.when(left, F.lit(kind)).alias("kind"), F.lit(None).cast("string").alias("value"), F.when(left, F.col("items")).alias("items")
            )
            s.tables[TABLE] = {**table, "folders": [*table["folders"], s.store.write(new)], "seq": seq}
            return changed.select("key", "reply")

        return self._in(action)

    def push_many(self, given: DataFrame, left: bool = False) -> DataFrame:
        """RPUSH (left: LPUSH) for every key; reply: the list's new length."""
        values, items = F.col("values"), F.col("items")
        after = F.concat(F.reverse(values), items) if left else F.concat(items, values)
        return self._change(given, "list", after, (F.size(items) + F.size(values)).cast("long"))

    def pop_many(self, given: DataFrame, count: int = 1, left: bool = True) -> DataFrame:
        """LPOP (not left: RPOP) of up to count items for every key of given (key); reply: the items."""
        items = F.col("items")
        n = F.least(F.lit(count), F.size(items))
        rest = F.slice(items, n + 1, F.size(items)) if left else F.slice(items, F.lit(1), F.size(items) - n)
        return self._change(given.select("key", F.array().cast("array<string>").alias("values")), "list", rest, F.slice(items if left else F.reverse(items), F.lit(1), n))

    def range_many(self, pattern: str, start: int, stop: int) -> DataFrame:
        """LRANGE for every list whose key matches: (key, reply)."""
        items = F.col("items")
        first = F.greatest(F.lit(0), F.lit(start) + F.size(items) if start < 0 else F.lit(start))
        last = F.lit(stop) + F.size(items) if stop < 0 else F.lit(stop)
        return self._of_kind(pattern, "list").select("key", F.slice(items, first + 1, F.greatest(F.lit(0), last - first + 1)).alias("reply"))

    def sizes(self, pattern: str, kind: str) -> DataFrame:
        """LLEN or SCARD for every key that matches: (key, reply)."""
        return self._of_kind(pattern, kind).select("key", F.size("items").cast("long").alias("reply"))

    def members(self, pattern: str) -> DataFrame:
        """SMEMBERS for every set whose key matches, a row for each: (key, reply)."""
        return self._of_kind(pattern, "set").select("key", F.explode("items").alias("reply"))

    def is_member(self, pattern: str, member: str) -> DataFrame:
        """SISMEMBER for every set whose key matches: (key, reply)."""
        return self._of_kind(pattern, "set").select("key", F.array_contains("items", member).alias("reply"))

    def _of_kind(self, pattern: str, kind: str) -> DataFrame:
        return self.rows(pattern).where(F.col("kind") == kind)

    def add_many(self, given: DataFrame) -> DataFrame:
        """SADD for every key; reply: how many members are new."""
        items, union = F.col("items"), F.array_union("items", "values")
        return self._change(given, "set", union, (F.size(union) - F.size(items)).cast("long"))

    def remove_many(self, given: DataFrame) -> DataFrame:
        """SREM for every key; reply: how many members went."""
        items, rest = F.col("items"), F.array_except("items", "values")
        return self._change(given, "set", rest, (F.size(items) - F.size(rest)).cast("long"))

    def set_many(self, given: DataFrame, kind: str = "bytes") -> None:
        """SET (kind "json": JSON.SET) for every row (key, value); each key once."""

        def action() -> None:
            s = self.session
            if kind == "json" and not given.where(F.try_parse_json("value").isNull()).isEmpty():
                raise SqlError("not JSON")
            if TABLE not in s.tables:
                s.tables[TABLE] = dict(DEFINITION)
            table = s.tables[TABLE]
            seq = table.get("seq", 0) + 1
            new = given.select("key", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.col("value").cast("string"), F.lit(None).cast("array<string>").alias("items"))
            s.tables[TABLE] = {**table, "folders": [*table["folders"], s.store.write(new)], "seq": seq}

        self._in(action)

    # Documents as rows

    def documents(self, prefix: str) -> DataFrame | None:
        """JSON values under ``prefix:`` as a table with inferred columns; ``id`` is the rest of the key where documents have none."""
        rows = self._rows().where((F.col("kind") == "json") & F.col("key").startswith(f"{prefix}:")).select("key", "value")
        if rows.isEmpty():
            return None
        path = f"{files.shared_dir(self.session.spark)}/brindle-json-{uuid.uuid4().hex}"
        rows.select("value").write.text(path)
        schema = self.session.spark.read.json(path).schema
        files.delete(self.session.spark, path)
        out = rows.select("key", F.from_json("value", schema).alias("d")).select("key", "d.*")
        if "id" not in schema.fieldNames():
            out = out.withColumn("id", F.substring_index("key", ":", -1))
        return out.select("id", *[f"`{c}`" for c in out.columns if c not in ("key", "id")])
