"""A session: statements of the dialect, commands on keys, transactions."""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brindle.functions.types import cast, parse_type
from brindle.operators import constraints
from brindle.operators.constraints import ConstraintError, same
from brindle.operators.recursive import fixpoint
from brindle.plans.dialect import Names, Parser
from brindle.plans.lexer import SqlError, ident
from brindle.sources import files
from brindle.sources.store import Store, Transaction
from brindle.streaming.results import stream

ROW = "__row"
_LITERAL = r"NULL|-?\d+|\(?-\(?\d+\)?\)?|-?\d+\.\d+|'(?:[^'\\]|''|\\.)*'|true|false"


def _literal_kind(sql: str) -> str:
    return "NULL" if sql == "NULL" else "text" if sql[0] == "'" else "decimal" if "." in sql else "boolean" if sql in ("true", "false") else "integer"


SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.cteRecursionRowLimit": "-1",
}


@dataclass
class Result:
    """rows of a query or of RETURNING (None for none) and the number of rows a change touched."""

    rows: DataFrame | None = None
    count: int = 0

    def fetchall(self) -> list[dict]:
        return list(self)

    def __iter__(self) -> Iterator[dict]:
        return stream(self.rows) if self.rows is not None else iter(())


class Session:
    """Statements against one store. Without BEGIN every statement is a transaction of its own."""

    def __init__(self, spark: SparkSession, root: str | None = None, isolation: str = "serializable"):
        self.spark = spark
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        self.store = Store(spark, root or f"{files.shared_dir(spark)}/brindle-store-{uuid.uuid4().hex}", isolation)
        self.transaction: Transaction | None = None
        self.current: Transaction | None = None
        self._views: list[str] = []

    # Statements

    def sql(self, text: str, params: list | None = None) -> DataFrame:
        """The rows of a query (or of RETURNING)."""
        rows = self.execute(text, params).rows
        if rows is None:
            raise SqlError("the statement returns no rows")
        return rows

    def execute(self, text: str, params: list | None = None) -> Result:
        parser = Parser(text, Names(self._relation, self._recursive), params)
        word = parser.token.upper
        if word in ("BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE"):
            return self._transaction_word(parser)
        kinds = {
            "SELECT": self._query, "WITH": self._query, "VALUES": self._query, "(": self._query, "INSERT": self._insert,
            "UPDATE": self._update, "DELETE": self._delete, "TRUNCATE": self._truncate, "CREATE": self._create,
            "DROP": self._drop, "ALTER": self._alter,
        }
        if word not in kinds:
            raise SqlError(f"unknown statement {parser.token.text!r}")
        try:
            return self.within(lambda: kinds[word](parser))
        finally:
            # Plans are analysed by now and no longer need the names.
            while self._views:
                self.spark.catalog.dropTempView(self._views.pop())

    def within(self, action: Callable):
        """Run action in the open transaction, or in one of its own that is committed after it."""
        if self.current is not None:
            return action()
        self.current = self.transaction or self.store.begin()
        saved = copy.deepcopy(self.current.state)
        try:
            out = action()
            if self.transaction is None:
                self.store.commit(self.current)
            return out
        except BaseException:
            self.current.state = saved
            raise
        finally:
            self.current = None

    def _transaction_word(self, p: Parser) -> Result:
        word = p.next().upper
        if word == "ROLLBACK" and p.accept("TO"):
            word = "ROLLBACK TO"
            p.accept("SAVEPOINT")
        elif word == "RELEASE":
            p.accept("SAVEPOINT")
        elif word in ("BEGIN", "COMMIT", "ROLLBACK"):
            p.accept("TRANSACTION")
        name = p.identifier() if word in ("SAVEPOINT", "RELEASE", "ROLLBACK TO") else ""
        p.end()
        t = self.transaction
        if word == "BEGIN":
            if t is not None:
                raise SqlError("a transaction is open")
            self.transaction = self.store.begin()
            return Result()
        if t is None:
            raise SqlError("no transaction is open")
        if word == "COMMIT":
            self.transaction = None
            self.store.commit(t)
        elif word == "ROLLBACK":
            self.transaction = None
        elif word == "SAVEPOINT":
            t.saved.append((name, copy.deepcopy(t.state)))
        else:
            places = [i for i, (n, _) in enumerate(t.saved) if n == name]
            if not places:
                raise SqlError(f"no savepoint {name}")
            if word == "ROLLBACK TO":
                t.state = copy.deepcopy(t.saved[places[-1]][1])
                del t.saved[places[-1] + 1 :]
            else:
                del t.saved[places[-1] :]
        return Result()

    # Relations

    @property
    def tables(self) -> dict:
        return self.current.state["tables"]

    @staticmethod
    def key(name: str) -> str:
        return name.lower().removeprefix("public.")

    def definition(self, name: str) -> dict:
        found = self.tables.get(self.key(name))
        if found is None:
            raise SqlError(f"table '{name}' does not exist")
        self.current.read.add(self.key(name))
        return found

    @staticmethod
    def schema(table: dict) -> StructType:
        from pyspark.sql.types import _parse_datatype_string

        return StructType([StructField(c["name"], _parse_datatype_string(parse_type(c["type"]).spark)) for c in table["columns"]])

    def frame(self, name: str) -> DataFrame:
        table = self.definition(name)
        return self.store.read(table["folders"], self.schema(table))

    def _relation(self, name: str) -> str:
        key = self.key(name)
        if key in self.current.state["views"]:
            inner = Parser(self.current.state["views"][key], Names(self._relation, self._recursive))
            out = inner.query()
            inner.end()
            return f"({out})"
        if key in self.tables:
            return self._view(self.frame(name))
        if "." not in name and self.spark.catalog.tableExists(name):
            return ident(name)
        documents = self.kv.documents(key) if "__kv" in self.tables else None
        if documents is None:
            raise SqlError(f"table '{name}' does not exist")
        return self._view(documents)

    def _view(self, df: DataFrame) -> str:
        """A name for df until the statement ends."""
        name = f"brindle_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self._views.append(name)
        return ident(name)

    def _recursive(self, name: str, columns: list[str] | None, first: str, step: str) -> str:
        start = self.spark.sql(first)
        start = start.toDF(*(columns or start.columns))

        def following(work: DataFrame) -> DataFrame:
            work.createOrReplaceTempView(name)
            try:
                return self.spark.sql(step)
            finally:
                self.spark.catalog.dropTempView(name)

        return self._view(fixpoint(start, following))

    def _query(self, p: Parser) -> Result:
        sql = p.query()
        p.end()
        return Result(self.spark.sql(sql))

    # Changes of rows

    def _put(self, name: str, folders: list[str]) -> None:
        table = self.tables[self.key(name)]
        self.tables[self.key(name)] = {**table, "folders": folders}

    def _typed(self, rows: DataFrame, table: dict) -> DataFrame:
        """rows (of all columns, any types) cast to the declared types."""
        have = {n.lower(): t for n, t in rows.dtypes}
        shown = []
        for c in table["columns"]:
            kind = parse_type(c["type"])
            same_binary = kind.base == "BYTEA" and have[c["name"].lower()] == "binary"
            shown.append(F.col(f"`{c['name']}`") if same_binary else F.expr(cast(ident(c["name"]), kind)).alias(c["name"]))
        return rows.select(*shown)

    def _written(self, df: DataFrame) -> tuple[str, DataFrame]:
        folder = self.store.write(df)
        return folder, self.store.read([folder], df.schema)

    def _returning(self, p: Parser) -> list[str] | None:
        return p.listed(p.item) if p.accept("RETURNING") else None

    def _returned(self, items: list[str] | None, rows: DataFrame, alias: str) -> DataFrame | None:
        return self.spark.sql(f"SELECT {', '.join(items)} FROM {self._view(rows)} AS {ident(alias)}") if items else None

    def _verify(self, name: str, rows: DataFrame, existing: DataFrame | None, keys: bool = True) -> None:
        """All constraints of a table (keys: unique ones too) on new rows, existing being the rows they join."""
        table = self.definition(name)
        for c in table["columns"]:
            if not c["nullable"]:
                constraints.not_null(rows, c["name"])
        for k in table["constraints"]:
            if k["kind"] == "CHECK":
                p = Parser(k["test"], Names(self._relation))
                constraints.check(rows, k["name"], p.expr().sql)
            elif k["kind"] in ("PRIMARY KEY", "UNIQUE"):
                if keys:
                    constraints.unique(rows, k["columns"], k["name"], existing)
            elif k["kind"] == "FOREIGN KEY":
                parent = self.frame(k["table"])
                if self.key(k["table"]) == self.key(name):
                    parent = parent.unionByName(rows)
                constraints.references(rows, k["columns"], parent, k["parent"], k["name"])

    def _insert(self, p: Parser) -> Result:
        p.expect("INSERT", "INTO")
        name = p.qualified()
        columns = p.in_parens(p.identifier) if p.token.upper == "(" else None
        alias = name.rpartition(".")[2]
        if p.token.upper == "VALUES":
            p.next()
            rows = p.listed(lambda: p.in_parens(p.expr))
            if len({len(r) for r in rows}) > 1 or (columns and len(rows[0]) != len(columns)):
                raise SqlError("INSERT has rows of another number of values than columns")
            values = [", ".join(f"{e.sql} AS c{i}" for i, e in enumerate(r)) for r in rows]
        else:
            values, source = None, p.query()
        conflict = self._conflict(p)
        items = self._returning(p)
        p.end()
        if self.key(name) not in self.tables:
            if self.key(name) in self.current.state["views"] or not columns:
                raise SqlError(f"table '{name}' does not exist, and no columns are given")
            sample = self.spark.sql(f"SELECT {values[0]}" if values else source)
            kinds = {"int": "BIGINT", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}
            self.tables[self.key(name)] = {
                "columns": [{"name": c, "type": kinds.get(t, "TEXT"), "nullable": True, "default": None} for c, (_, t) in zip(columns, sample.dtypes, strict=True)],
                "constraints": [], "folders": [],
            }
        table = self.definition(name)
        declared = [c["name"] for c in table["columns"]]
        wanted = columns or declared
        if values:
            # Each row is cast on its own, for rows may differ in their values' types.
            kinds = {c["name"].lower(): parse_type(c["type"]) for c in table["columns"]}
            missing = [c for c in wanted if c.lower() not in kinds]
            if missing or len(rows[0]) > len(wanted):
                raise SqlError(f"unknown column {missing[0]!r}" if missing else "INSERT has more values than columns")
            wanted = wanted[: len(rows[0])]
            given = self._values(rows, wanted, kinds)
        else:
            given = self.spark.sql(source)
            if len(given.columns) != len(wanted):
                raise SqlError(f"INSERT has {len(wanted)} columns and {len(given.columns)} values")
            given = given.toDF(*wanted)
        have = {c.lower() for c in wanted}
        unknown = have - {c.lower() for c in declared}
        if unknown:
            raise SqlError(f"unknown column {sorted(unknown)[0]!r}")
        for c in table["columns"]:
            if c["name"].lower() not in have:
                default = Parser(c["default"], Names(self._relation)).expr().sql if c["default"] else "NULL"
                given = given.withColumn(c["name"], F.expr(cast(default, parse_type(c["type"]))))
        given = given.select(*[F.col(f"`{c}`").alias(c) for c in declared]) if values else self._typed(given, table)
        folder, new = self._written(self._clustered(name, given))
        old = self.frame(name)
        if conflict is None:
            self._verify(name, new, old)
            self._put(name, [*table["folders"], folder])
            return Result(self._returned(items, new, alias), new.count())
        return self._insert_or(name, table, new, old, conflict, items, alias)

    def _values(self, rows: list[list], columns: list[str], kinds: dict) -> DataFrame:
        """The rows of VALUES in one relation. Columns of plain literals are cast once, others value by value."""
        names = ", ".join(map(ident, columns))
        literal = [all(re.fullmatch(_LITERAL, r[i].sql) for r in rows) and len({_literal_kind(r[i].sql) for r in rows} - {"NULL"}) <= 1 for i in range(len(columns))]
        shown = [[e.sql if literal[i] else cast(e.sql, kinds[columns[i].lower()]) for i, e in enumerate(r)] for r in rows]
        after = [cast(ident(c), kinds[c.lower()]) if literal[i] else ident(c) for i, c in enumerate(columns)]
        # What VALUES can't evaluate makes a SELECT for each row.
        if any("SELECT" in e or "raise_error" in e for r in shown for e in r):
            relation = " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {ident(c)}" for c, e in zip(columns, r, strict=True)) for r in shown)
        else:
            relation = f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in shown)} AS given({names})"
        return self.spark.sql(f"SELECT {', '.join(f'{e} AS {ident(c)}' for c, e in zip(columns, after, strict=True))} FROM ({relation})")

    def _conflict(self, p: Parser) -> tuple | None:
        """(target columns or None, SET items or None for nothing, WHERE)."""
        if not p.accept("ON", "CONFLICT"):
            return None
        target = p.in_parens(p.identifier) if p.token.upper == "(" else None
        p.expect("DO")
        if p.accept("NOTHING"):
            return target, None, None
        p.expect("UPDATE", "SET")
        sets = p.listed(lambda: self._set_item(p))
        return target, sets, p.expr().sql if p.accept("WHERE") else None

    @staticmethod
    def _set_item(p: Parser) -> tuple[str, str]:
        column = p.qualified().rpartition(".")[2]
        p.expect("=")
        return column, p.expr().sql

    def _insert_or(self, name: str, table: dict, new: DataFrame, old: DataFrame, conflict: tuple, items: list[str] | None, alias: str) -> Result:
        target, sets, where = conflict
        keys = [k["columns"] for k in table["constraints"] if k["kind"] in ("PRIMARY KEY", "UNIQUE")]
        target = target or (keys[0] if keys else None)
        if target is None or not any({c.lower() for c in k} == {c.lower() for c in target} for k in keys):
            raise SqlError("ON CONFLICT needs a key")
        if sets is None:
            # Of new rows with equal keys one is kept; rows with a null key meet nothing.
            whole = " AND ".join(f"{ident(c)} IS NOT NULL" for c in target)
            fresh = new.where(whole).dropDuplicates(target).unionByName(new.where(f"NOT ({whole})"))
            folder, fresh = self._written(fresh.alias("n").join(old.alias("o"), same("n", "o", target), "left_anti"))
            self._verify(name, fresh, old)
            self._put(name, [*table["folders"], folder])
            return Result(self._returned(items, fresh, alias), fresh.count())
        constraints.unique(new, target, "ON CONFLICT")
        on = " AND ".join(f"{ident(alias)}.{ident(c)} = excluded.{ident(c)}" for c in target)
        met = f"{self._view(old)} AS {ident(alias)} JOIN {self._view(new)} AS excluded ON {on}"
        # In SET a bare column is the old row's.
        changes = {c.lower(): e for c, e in sets}
        bare = {c["name"].lower() for c in table["columns"]}

        def owned(e: str) -> str:
            return re.sub(r"(?<![.`\w])`(\w+)`(?![.`(])", lambda m: f"{ident(alias)}.{m[0]}" if m[1].lower() in bare else m[0], e)

        test = f"coalesce({owned(where)}, false)" if where else "true"
        shown = [
            f"CASE WHEN {test} THEN {cast(owned(changes[n.lower()]), parse_type(c['type']))} ELSE {ident(alias)}.{ident(n)} END AS {ident(n)}" if (n := c["name"]).lower() in changes else f"{ident(alias)}.{ident(n)} AS {ident(n)}"
            for c in table["columns"]
        ]
        _, updated = self._written(self.spark.sql(f"SELECT {', '.join(shown)}, {test} AS {ROW} FROM {met}"))
        touched = updated.where(ROW).drop(ROW)
        kept = old.alias("o").join(new.alias("n"), same("o", "n", target), "left_anti")
        fresh = new.alias("n").join(old.alias("o"), same("n", "o", target), "left_anti")
        self._replace(name, old, kept.unionByName(updated.drop(ROW)).unionByName(fresh), touched.unionByName(fresh))
        changed = touched.unionByName(fresh)
        return Result(self._returned(items, changed, alias), changed.count())

    def _replace(self, name: str, old: DataFrame, rows: DataFrame, changed: DataFrame | None) -> None:
        """Give a table new rows, of which ``changed`` are to be verified (with the whole table's keys)."""
        table = self.tables[self.key(name)]
        folder, now = self._written(self._clustered(name, rows.select(*[f"`{c['name']}`" for c in table["columns"]])))
        self._put(name, [folder])
        if changed is not None:
            for k in table["constraints"]:
                if k["kind"] in ("PRIMARY KEY", "UNIQUE"):
                    constraints.unique(now, k["columns"], k["name"])
            self._verify(name, changed, None, keys=False)

    def _clustered(self, name: str, rows: DataFrame) -> DataFrame:
        """rows in the order of the table's index on columns, if it has one, so that scans prune files by their statistics."""
        on = next((x["columns"] for x in self.current.state["indexes"].values() if x["table"] == self.key(name) and x.get("columns")), None)
        return rows.sortWithinPartitions(*[f"`{c}`" for c in on]) if on else rows

    def _indexes_of(self, name: str, change: Callable[[dict], None]) -> None:
        for x in self.current.state["indexes"].values():
            if x["table"] == self.key(name) and x.get("columns"):
                change(x)

    def _numbered(self, name: str) -> DataFrame:
        """The table's rows with a number each, written, so that the numbers hold."""
        return files.written(self.frame(name).withColumn(ROW, F.monotonically_increasing_id()))

    def _from(self, p: Parser, word: str) -> list[str]:
        return p.listed(p.table) if p.accept(word) else []

    def _update(self, p: Parser) -> Result:
        p.expect("UPDATE")
        name, alias = self._target(p)
        p.expect("SET")
        sets = p.listed(lambda: self._set_item(p))
        others = self._from(p, "FROM")
        where = p.expr().sql if p.accept("WHERE") else "true"
        items = self._returning(p)
        p.end()
        table = self.definition(name)
        kinds = {c["name"].lower(): parse_type(c["type"]) for c in table["columns"]}
        for c, _ in sets:
            if c.lower() not in kinds:
                raise SqlError(f"unknown column {c!r}")
        if not others and "SELECT" not in where and not any("SELECT" in e for _, e in sets) and not self._children(name):
            return self._update_in_one_pass(name, alias, {c.lower(): e for c, e in sets}, where, kinds, items)
        old = self._numbered(name)
        shown = [f"{cast(e, kinds[c.lower()])} AS {ident(c)}" for c, e in sets]
        source = " CROSS JOIN ".join([f"{self._view(old)} AS {ident(alias)}", *others])
        met = self.spark.sql(f"SELECT {ident(alias)}.{ROW} AS {ROW}, {', '.join(shown)} FROM {source} WHERE {where}")
        if others:
            # A row that meets several takes the least of their new values.
            met = met.groupBy(ROW).agg(F.min(F.struct(*[c for c, _ in sets])).alias("least")).select(ROW, *[F.col(f"least.`{c}`").alias(c) for c, _ in sets])
        met = files.written(met)
        new = {c.lower(): c for c, _ in sets}
        columns = [F.col(f"n.`{new[c.lower()]}`").alias(c) if c.lower() in new else F.col(f"o.`{c}`") for c in (x["name"] for x in table["columns"])]
        touched = files.written(old.alias("o").join(met.alias("n"), F.col(f"o.{ROW}") == F.col(f"n.{ROW}")).select(F.col(f"o.{ROW}"), *columns))
        kept = old.join(met.select(ROW), ROW, "left_anti")
        self._replace(name, old, kept.unionByName(touched).drop(ROW), touched.drop(ROW))
        self._parents_changed(name, old, touched)
        return Result(self._returned(items, touched.drop(ROW), alias), touched.count())

    def _update_in_one_pass(self, name: str, alias: str, sets: dict[str, str], where: str, kinds: dict, items: list[str] | None) -> Result:
        """An UPDATE that reads nothing but its table: written once, with a mark on the rows that change."""
        table = self.tables[self.key(name)]
        test = f"coalesce({where}, false)"
        shown = [
            f"CASE WHEN {test} THEN {cast(sets[n.lower()], kinds[n.lower()])} ELSE {ident(alias)}.{ident(n)} END AS {ident(n)}" if n.lower() in sets else f"{ident(alias)}.{ident(n)} AS {ident(n)}"
            for n in (c["name"] for c in table["columns"])
        ]
        marked = self.spark.sql(f"SELECT {', '.join(shown)}, {test} AS {ROW} FROM {self._view(self.frame(name))} AS {ident(alias)}")
        folder, now = self._written(self._clustered(name, marked))
        touched = now.where(ROW).drop(ROW)
        self._put(name, [folder])
        for k in table["constraints"]:
            if k["kind"] in ("PRIMARY KEY", "UNIQUE") and any(c.lower() in sets for c in k["columns"]):
                constraints.unique(now, k["columns"], k["name"])
        self._verify(name, touched, None, keys=False)
        return Result(self._returned(items, touched, alias), touched.count())

    @staticmethod
    def _target(p: Parser) -> tuple[str, str]:
        name = p.qualified()
        if p.accept("AS") or (p.token.kind == "word" and p.token.upper not in ("SET", "WHERE", "USING", "FROM", "RETURNING")):
            return name, p.identifier()
        return name, name.rpartition(".")[2]

    def _delete(self, p: Parser) -> Result:
        p.expect("DELETE", "FROM")
        name, alias = self._target(p)
        others = self._from(p, "USING")
        where = p.expr().sql if p.accept("WHERE") else "true"
        items = self._returning(p)
        p.end()
        if not others and "SELECT" not in where:
            table = f"{self._view(self.frame(name))} AS {ident(alias)}"
            removed = self.spark.sql(f"SELECT * FROM {table} WHERE coalesce({where}, false)")
            kept = self.spark.sql(f"SELECT * FROM {table} WHERE NOT coalesce({where}, false)")
            count = removed.count()
            self._put(name, [self.store.write(self._clustered(name, kept))])
            self._parents_removed(name, removed)
            return Result(self._returned(items, removed, alias), count)
        old = self._numbered(name)
        source = " CROSS JOIN ".join([f"{self._view(old)} AS {ident(alias)}", *others])
        gone = files.written(self.spark.sql(f"SELECT DISTINCT {ident(alias)}.{ROW} AS {ROW} FROM {source} WHERE {where}"))
        return self._deleted(name, old, gone, items, alias)

    def _deleted(self, name: str, old: DataFrame, gone: DataFrame, items: list[str] | None = None, alias: str = "t") -> Result:
        removed = old.join(gone, ROW, "left_semi").drop(ROW)
        self._replace(name, old, old.join(gone, ROW, "left_anti").drop(ROW), None)
        self._parents_removed(name, removed)
        return Result(self._returned(items, removed, alias), gone.count())

    def _truncate(self, p: Parser) -> Result:
        p.expect("TRUNCATE")
        p.accept("TABLE")
        name = p.qualified()
        p.end()
        old = self._numbered(name)
        return self._deleted(name, old, old.select(ROW))

    # Foreign keys

    def _children(self, name: str) -> list[tuple[str, dict]]:
        own = self.key(name)
        return [(child, k) for child, t in list(self.tables.items()) for k in t["constraints"] if k["kind"] == "FOREIGN KEY" and self.key(k["table"]) == own]

    def _parents_removed(self, name: str, removed: DataFrame) -> None:
        """ON DELETE of all tables that refer to the removed rows, and of those that refer to them in turn."""
        for child, k in self._children(name):
            rows = self._numbered(child)
            hit = files.written(rows.alias("c").join(removed.alias("p"), same("c", "p", k["columns"], k["parent"]), "left_semi").select(ROW))
            if hit.isEmpty():
                continue
            if k["on_delete"] == "CASCADE":
                self._deleted(child, rows, hit)
            else:
                self._child_values(child, k, rows, hit, k["on_delete"])

    def _parents_changed(self, name: str, old: DataFrame, touched: DataFrame) -> None:
        """ON UPDATE of all tables that refer to a key that has changed."""
        for child, k in self._children(name):
            columns = [F.col(f"o.`{c}`").alias(f"old{i}") for i, c in enumerate(k["parent"])] + [F.col(f"n.`{c}`").alias(f"new{i}") for i, c in enumerate(k["parent"])]
            moved = old.alias("o").join(touched.alias("n"), F.col(f"o.{ROW}") == F.col(f"n.{ROW}")).select(*columns)
            moved = files.written(moved.where(" OR ".join(f"NOT (old{i} <=> new{i})" for i in range(len(k["parent"])))))
            if moved.isEmpty():
                continue
            rows = self._numbered(child)
            met = rows.alias("c").join(moved.alias("m"), [F.col(f"c.`{c}`") == F.col(f"m.old{i}") for i, c in enumerate(k["columns"])])
            if k["on_update"] != "CASCADE":
                hit = files.written(met.select(F.col(f"c.{ROW}")).distinct())
                if not hit.isEmpty():
                    self._child_values(child, k, rows, hit, k["on_update"])
                continue
            kinds = {c["name"].lower(): parse_type(c["type"]).spark for c in self.tables[child]["columns"]}
            own = {c.lower(): i for i, c in enumerate(k["columns"])}
            shown = [F.col(f"m.new{own[c.lower()]}").cast(kinds[c.lower()]).alias(c) if c.lower() in own else F.col(f"c.`{c}`") for c in rows.columns]
            changed = files.written(met.select(*shown))
            if not changed.isEmpty():
                self._replace(child, rows, rows.join(changed.select(ROW), ROW, "left_anti").unionByName(changed).drop(ROW), changed.drop(ROW))
                self._parents_changed(child, rows, changed)

    def _child_values(self, child: str, k: dict, rows: DataFrame, hit: DataFrame, action: str) -> None:
        if action not in ("SET NULL", "SET DEFAULT"):
            raise ConstraintError(f"FOREIGN KEY constraint '{k['name']}' of '{child}' forbids the change")
        table = self.tables[child]
        own = {c.lower() for c in k["columns"]}
        shown = []
        for c in table["columns"]:
            if c["name"].lower() in own:
                default = Parser(c["default"], Names(self._relation)).expr().sql if action == "SET DEFAULT" and c["default"] else "NULL"
                shown.append(F.expr(cast(default, parse_type(c["type"]))).alias(c["name"]))
            else:
                shown.append(F.col(f"`{c['name']}`"))
        changed = files.written(rows.join(hit, ROW, "left_semi").select(ROW, *shown))
        self._replace(child, rows, rows.join(hit, ROW, "left_anti").unionByName(changed).drop(ROW), changed.drop(ROW))
        self._parents_changed(child, rows, changed)

    # Definitions

    def _create(self, p: Parser) -> Result:
        p.expect("CREATE")
        is_unique = p.accept("UNIQUE")
        if p.accept("INDEX"):
            return self._create_index(p, is_unique)
        if p.accept("SCHEMA"):
            name = p.identifier().lower()
            p.end()
            if name in self.current.state["schemas"]:
                raise SqlError(f"schema '{name}' exists")
            self.current.state["schemas"].append(name)
            return Result()
        if p.accept("VIEW"):
            name = p.qualified()
            p.expect("AS")
            text = p.text[p.token.at :].rstrip().rstrip(";")
            p.query()
            p.end()
            if self.key(name) in self.current.state["views"] or self.key(name) in self.tables:
                raise SqlError(f"'{name}' exists")
            self.current.state["views"][self.key(name)] = text
            return Result()
        p.expect("TABLE")
        quiet = p.accept("IF", "NOT", "EXISTS")
        name = p.qualified()
        table: dict = {"columns": [], "constraints": [], "folders": []}
        p.expect("(")
        while True:
            if p.token.upper in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                table["constraints"].append(self._constraint(p, name))
            else:
                self._column(p, name, table)
            if not p.accept(","):
                break
        p.expect(")")
        p.end()
        if self.key(name) in self.tables:
            if quiet:
                return Result()
            raise SqlError(f"table '{name}' exists")
        schema = name.rpartition(".")[0].lower()
        if schema and schema not in self.current.state["schemas"]:
            raise SqlError(f"schema '{schema}' does not exist")
        names = [c["name"].lower() for c in table["columns"]]
        if len(set(names)) < len(names):
            raise SqlError("a column is declared twice")
        for k in table["constraints"]:
            self._settle(name, table, k)
        self.tables[self.key(name)] = table
        return Result()

    def _settle(self, name: str, table: dict, k: dict) -> None:
        """Check a constraint's columns and its parent's key."""
        by = {c["name"].lower(): c for c in table["columns"]}
        for c in k.get("columns", []):
            if c.lower() not in by:
                raise SqlError(f"unknown column {c!r}")
            if k["kind"] == "PRIMARY KEY":
                by[c.lower()]["nullable"] = False
        if k["kind"] == "FOREIGN KEY":
            parent = table if self.key(k["table"]) == self.key(name) else self.definition(k["table"])
            keys = [x["columns"] for x in parent["constraints"] if x["kind"] in ("PRIMARY KEY", "UNIQUE")]
            if not k["parent"]:
                k["parent"] = next((x["columns"] for x in parent["constraints"] if x["kind"] == "PRIMARY KEY"), [])
            if not any({c.lower() for c in x} == {c.lower() for c in k["parent"]} for x in keys):
                raise SqlError(f"'{k['table']}' has no key on the columns referred to")

    def _column(self, p: Parser, table_name: str, table: dict) -> None:
        column = {"name": p.identifier(), "type": p.type().text, "nullable": True, "default": None}
        table["columns"].append(column)
        while p.token.upper not in (",", ")", ";") and p.token.kind != "end":
            given = p.identifier() if p.accept("CONSTRAINT") else None
            if p.accept("NOT", "NULL"):
                column["nullable"] = False
            elif p.accept("NULL"):
                continue
            elif p.accept("DEFAULT"):
                column["default"] = self._source_text(p, p.unary)
            else:
                table["constraints"].append(self._constraint(p, table_name, column["name"], given))

    @staticmethod
    def _source_text(p: Parser, parse: Callable) -> str:
        at = p.token.at
        parse()
        return p.text[at : p.token.at].strip()

    def _constraint(self, p: Parser, table: str, column: str | None = None, given: str | None = None) -> dict:
        if p.accept("CONSTRAINT"):
            given = p.identifier()
        columns = lambda: [column] if column else p.in_parens(p.identifier)
        base = table.rpartition(".")[2]
        if p.accept("PRIMARY", "KEY"):
            return {"kind": "PRIMARY KEY", "name": given or f"{base}_pkey", "columns": columns()}
        if p.accept("UNIQUE"):
            own = columns()
            return {"kind": "UNIQUE", "name": given or f"{base}_{'_'.join(own)}_key", "columns": own}
        if p.accept("CHECK"):
            p.expect("(")
            text = self._source_text(p, p.expr)
            p.expect(")")
            return {"kind": "CHECK", "name": given or f"{base}_check", "test": text}
        if p.accept("FOREIGN", "KEY"):
            own = columns()
        else:
            own = [column]
        p.expect("REFERENCES")
        parent = p.qualified()
        k = {"kind": "FOREIGN KEY", "name": given or f"{base}_{'_'.join(map(str, own))}_fkey", "columns": own, "table": parent, "on_delete": "NO ACTION", "on_update": "NO ACTION"}
        k["parent"] = p.in_parens(p.identifier) if p.token.upper == "(" else []
        while p.accept("ON"):
            event = "on_delete" if p.accept("DELETE") else (p.expect("UPDATE"), "on_update")[1]
            for action in ("CASCADE", "RESTRICT", "NO ACTION", "SET NULL", "SET DEFAULT"):
                if p.accept(*action.split()):
                    k[event] = action
                    break
            else:
                raise SqlError("unknown action")
        return k

    def _create_index(self, p: Parser, is_unique: bool) -> Result:
        name = p.identifier()
        p.expect("ON")
        table = p.qualified()
        at = p.token.at
        columns = [e.name for e in p.in_parens(p.expr)]
        text = p.text[at : p.token.at].strip()
        p.end()
        if self.key(name) in self.current.state["indexes"]:
            raise SqlError(f"index '{name}' exists")
        definition = self.definition(table)
        if is_unique:
            if None in columns:
                raise SqlError("a unique index is on columns")
            constraints.unique(self.frame(table), columns, name)
            changed = {**definition, "constraints": [*definition["constraints"], {"kind": "UNIQUE", "name": name, "columns": columns}]}
            self.tables[self.key(table)] = changed
        declared = {c["name"].lower() for c in definition["columns"]}
        own = columns if None not in columns and {c.lower() for c in columns} <= declared else None
        self.current.state["indexes"][self.key(name)] = {"table": self.key(table), "on": text, "unique": is_unique, "columns": own}
        if own and definition["folders"]:
            # An index is an order of the rows, by which scans prune files and row groups.
            dealt = self.frame(table).repartitionByRange(*[f"`{c}`" for c in own])
            self._put(table, [self.store.write(self._clustered(table, dealt))])
        return Result()

    def _drop(self, p: Parser) -> Result:
        p.expect("DROP")
        kind = p.identifier().upper()
        part = {"TABLE": "tables", "VIEW": "views", "INDEX": "indexes"}.get(kind)
        if part is None:
            raise SqlError(f"can't drop {kind}")
        quiet = p.accept("IF", "EXISTS")
        name = p.qualified()
        cascade = p.accept("CASCADE")
        p.end()
        if self.key(name) not in self.current.state[part]:
            if quiet:
                return Result()
            raise SqlError(f"'{name}' does not exist")
        if part == "tables":
            for child, k in self._children(name):
                if child == self.key(name):
                    continue
                if not cascade:
                    raise ConstraintError(f"'{child}' refers to '{name}' by '{k['name']}'")
                rest = [x for x in self.tables[child]["constraints"] if x is not k]
                self.tables[child] = {**self.tables[child], "constraints": rest}
            for index in [n for n, x in self.current.state["indexes"].items() if x["table"] == self.key(name)]:
                del self.current.state["indexes"][index]
        del self.current.state[part][self.key(name)]
        return Result()

    def _alter(self, p: Parser) -> Result:
        p.expect("ALTER", "TABLE")
        name = p.qualified()
        table = copy.deepcopy(self.definition(name))
        by = {c["name"].lower(): c for c in table["columns"]}

        def column() -> dict:
            c = p.identifier()
            if c.lower() not in by:
                raise SqlError(f"unknown column {c!r}")
            return by[c.lower()]

        rows: DataFrame | None = None
        if p.accept("RENAME", "TO"):
            new = p.qualified()
            if self.key(new) in self.tables:
                raise SqlError(f"table '{new}' exists")
            del self.tables[self.key(name)]
            self._indexes_of(name, lambda x: x.update(table=self.key(new)))
            for child in self.tables.values():
                for k in child["constraints"]:
                    if k["kind"] == "FOREIGN KEY" and self.key(k["table"]) == self.key(name):
                        k["table"] = new
            name = new
        elif p.accept("RENAME"):
            p.accept("COLUMN")
            c = column()
            p.expect("TO")
            new, old = p.identifier(), c["name"]
            rows = self.frame(name).withColumnRenamed(old, new)
            c["name"] = new
            self._indexes_of(name, lambda x: x.update(columns=[new if n.lower() == old.lower() else n for n in x["columns"]]))
            for k in table["constraints"]:
                if "columns" in k:
                    k["columns"] = [new if x.lower() == old.lower() else x for x in k["columns"]]
                if "test" in k:
                    k["test"] = re.sub(rf"(?i)\b{re.escape(old)}\b", new, k["test"])
            for _, k in self._children(name):
                k["parent"] = [new if x.lower() == old.lower() else x for x in k["parent"]]
        elif p.accept("ADD"):
            if p.token.upper in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                k = self._constraint(p, name)
                if any(x["name"] == k["name"] for x in table["constraints"]):
                    raise SqlError(f"constraint '{k['name']}' exists")
                self._settle(name, table, k)
                table["constraints"].append(k)
            else:
                p.accept("COLUMN")
                before = len(table["constraints"])
                self._column(p, name, table)
                c = table["columns"][-1]
                if c["name"].lower() in by:
                    raise SqlError(f"column '{c['name']}' exists")
                for k in table["constraints"][before:]:
                    self._settle(name, table, k)
                # Folders are read by name, and may hold a dropped column of this one.
                if c["default"] or c["name"].lower() in table.get("dropped", []):
                    default = Parser(c["default"], Names(self._relation)).expr().sql if c["default"] else "NULL"
                    rows = self.frame(name).withColumn(c["name"], F.expr(cast(default, parse_type(c["type"]))))
        elif p.accept("DROP", "CONSTRAINT"):
            k = p.identifier()
            if not any(x["name"] == k for x in table["constraints"]):
                raise SqlError(f"no constraint '{k}'")
            table["constraints"] = [x for x in table["constraints"] if x["name"] != k]
            self.current.state["indexes"].pop(self.key(k), None)
        elif p.accept("DROP"):
            p.accept("COLUMN")
            c = column()
            table["columns"].remove(c)
            lost = [n for n, x in self.current.state["indexes"].items() if x["table"] == self.key(name) and c["name"].lower() in map(str.lower, x.get("columns") or [])]
            for n in lost:
                del self.current.state["indexes"][n]
            table["dropped"] = [*table.get("dropped", []), c["name"].lower()]
            table["constraints"] = [k for k in table["constraints"] if c["name"].lower() not in map(str.lower, k.get("columns", []))]
        else:
            p.expect("ALTER")
            p.accept("COLUMN")
            c = column()
            if p.accept("SET", "DEFAULT"):
                c["default"] = self._source_text(p, p.unary)
            elif p.accept("DROP", "DEFAULT"):
                c["default"] = None
            elif p.accept("SET", "NOT", "NULL"):
                constraints.not_null(self.frame(name), c["name"])
                c["nullable"] = False
            elif p.accept("DROP", "NOT", "NULL"):
                c["nullable"] = True
            else:
                if p.accept("SET"):
                    p.expect("DATA")
                p.expect("TYPE")
                kind = p.type()
                rows = self.frame(name).withColumn(c["name"], F.expr(cast(ident(c["name"]), kind)))
                c["type"] = kind.text
        p.end()
        if rows is not None:
            table["folders"] = [self.store.write(rows.select(*[f"`{x['name']}`" for x in table["columns"]]))]
            table["dropped"] = []
        self.tables[self.key(name)] = table
        return Result()

    # Commands

    @property
    def kv(self):
        from brindle.sources.keyvalue import KeyValue

        return KeyValue(self)

    def vacuum(self) -> int:
        """Delete folders of superseded versions that this session's transaction doesn't need."""
        return self.store.vacuum([self.transaction.base, self.transaction.state] if self.transaction else [])

    def size(self) -> int:
        """Bytes of the store's files."""
        return files.bytes_in(self.spark, self.store.root)

    def create_path_index(self, name: str, prefix: str, path: str) -> int:
        """Name a JSON path of the keys under a prefix. It is kept as a definition: scans prune by column and file statistics."""

        def action() -> int:
            indexes = self.current.state["indexes"]
            if self.key(name) in indexes:
                return 0
            indexes[self.key(name)] = {"table": prefix.rstrip("*").rstrip(":"), "on": path, "unique": False}
            return 1

        return self.within(action)

    def drop_path_index(self, name: str) -> int:
        return self.within(lambda: int(self.current.state["indexes"].pop(self.key(name), None) is not None))

    def path_indexes(self) -> dict:
        return self.within(lambda: dict(self.current.state["indexes"]))

    def flush(self) -> None:
        """Delete all data."""
        if self.transaction is not None:
            raise SqlError("not inside a transaction")
        self.store.drop_everything()
