"""Cursors: SQL with parameters, commands, transactions."""

import pytest

from brindle.client import connect
from brindle.plans.lexer import SqlError


def test_cursor(spark, tmp_path):
    with connect(spark, str(tmp_path / "db")) as con:
        c = con.cursor()
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
        assert c.execute("INSERT INTO t VALUES (?, ?), (2, 'b')", [1, "it's"]).rowcount == 2
        c.execute("SELECT id, name FROM t ORDER BY id")
        assert [d[0] for d in c.description] == ["id", "name"]
        assert c.fetchone() == (1, "it's") and c.fetchmany(5) == [(2, "b")] and c.fetchone() is None
        assert c.execute("DELETE FROM t WHERE id = ?", [2]).rowcount == 1
        assert c.execute("PING").fetchone() == ("PONG",)
        assert c.execute("SET k ?", ["a b"]).fetchone() == ("OK",) and c.execute("GET k").fetchone() == ("a b",)
        assert c.execute("RPUSH l x y z").fetchone() == (3,) and c.execute("LRANGE l 0 -1").fetchall() == [("x",), ("y",), ("z",)]
        assert c.execute("JSON.SET u:1.a 5").fetchone() == ("OK",) and c.execute("DELETE k").fetchone() == (1,)
        assert c.execute("IDX.CREATE i u: a").fetchone() == (1,) and '"i"' in c.execute("IDX.LIST").fetchone()[0]
        assert c.execute("MEMUSAGE").fetchone()[0] > 0 and c.execute("VACUUM").fetchone()[0] >= 0
        c.execute("BEGIN")
        c.execute("SAVEPOINT s")
        c.execute("SET k 1")
        c.execute("ROLLBACK_TO_SAVEPOINT s")
        con.commit()
        assert c.execute("GET k").fetchone() is None
        for bad in ("NOPE", "GET", "SELECT ?"):
            with pytest.raises(SqlError):
                c.execute(bad)
