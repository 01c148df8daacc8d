"""The dialect end to end: queries, changes, constraints, definitions, transactions."""

import time

import pytest

from brindle.operators.constraints import ConstraintError
from brindle.plans.lexer import SqlError
from brindle.session import Session
from brindle.sources.store import Conflict


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, str(tmp_path / "store"))


def values(db, text, params=None):
    return [tuple(r) for r in db.sql(text, params).collect()]


@pytest.fixture
def harbour(db):
    db.execute("CREATE TABLE boats (no INTEGER PRIMARY KEY, port TEXT, kind TEXT, crew INTEGER, tons NUMERIC(8,1))")
    db.execute(
        "INSERT INTO boats VALUES (11,'Lerwick','yawl',3,4.5),(12,'Lerwick','ferry',22,880.0),(13,'Skagen','trawler',7,96.2),"
        "(14,NULL,'yawl',2,3.9),(15,'Skagen','ferry',18,640.0),(16,'Nuuk','trawler',9,120.4)"
    )
    db.execute("CREATE TABLE ports (port TEXT PRIMARY KEY, land TEXT, depth DOUBLE PRECISION)")
    db.execute("INSERT INTO ports VALUES ('Skagen','Denmark',9.5),('Nuuk','Greenland',11.0),('Lerwick','Scotland',9.0),('Brest','France',13.5)")
    return db


def test_joins_and_groups(harbour):
    heavy = "SELECT p.land, COUNT(*) AS n, MAX(b.crew) AS most FROM boats b JOIN ports p ON p.port = b.port GROUP BY p.land HAVING COUNT(*) > 1 ORDER BY p.land"
    assert values(harbour, heavy) == [("Denmark", 2, 18), ("Scotland", 2, 22)]
    outer = "SELECT p.port, b.no FROM ports p LEFT JOIN boats b ON b.port = p.port AND b.kind = 'trawler' ORDER BY p.port"
    assert values(harbour, outer) == [("Brest", None), ("Lerwick", None), ("Nuuk", 16), ("Skagen", 13)]
    assert harbour.sql("SELECT b.kind, SUM(b.crew) FROM boats b GROUP BY b.kind").columns == ["b.kind", "SUM(b.crew)"]


def test_first_rows_and_limits(harbour):
    assert values(harbour, "SELECT DISTINCT ON (kind) kind, no FROM boats ORDER BY kind, crew DESC") == [("ferry", 12), ("trawler", 16), ("yawl", 11)]
    assert values(harbour, "SELECT no FROM boats WHERE crew IN (?, ?) ORDER BY no DESC LIMIT 1 OFFSET 1", [2, 3]) == [(11,)]
    assert values(harbour, "SELECT CASE WHEN crew > 15 THEN 'big' END AS c FROM boats WHERE port = 'Skagen' ORDER BY no") == [(None,), ("big",)]


def test_set_operations(harbour):
    assert sorted(values(harbour, "SELECT port FROM boats INTERSECT SELECT port FROM ports")) == [("Lerwick",), ("Nuuk",), ("Skagen",)]
    assert values(harbour, "SELECT port FROM ports EXCEPT SELECT port FROM boats") == [("Brest",)]
    assert values(harbour, "SELECT land FROM ports ORDER BY land LIMIT 1 UNION SELECT 'Alba' AS land FROM ports") == [("Alba",)]
    # INTERSECT binds tighter, wherever it stands.
    assert sorted(values(harbour, "SELECT 1 AS a UNION SELECT 2 INTERSECT SELECT 2")) == [(1,), (2,)]
    assert sorted(values(harbour, "SELECT 3 AS a EXCEPT SELECT 3 INTERSECT SELECT 4")) == [(3,)]
    assert values(harbour, "(SELECT 1 AS a UNION SELECT 2) INTERSECT SELECT 2") == [(2,)]


def test_subqueries(harbour):
    of_ferries = "(SELECT crew FROM boats WHERE kind = 'trawler')"
    assert sorted(values(harbour, f"SELECT no FROM boats WHERE crew > ANY {of_ferries}")) == [(12,), (15,), (16,)]
    assert sorted(values(harbour, f"SELECT no FROM boats WHERE crew > ALL {of_ferries}")) == [(12,), (15,)]
    top = "SELECT p.land, (SELECT MAX(b.tons) FROM boats b WHERE b.port = p.port) AS most FROM ports p ORDER BY p.land LIMIT 2"
    assert [(a, b and float(b)) for a, b in values(harbour, top)] == [("Denmark", 640.0), ("France", None)]
    assert values(harbour, "WITH a AS (SELECT no, port FROM boats), b AS (SELECT no FROM a WHERE port IS NULL) SELECT no FROM b") == [(14,)]


def test_recursion(db):
    db.execute("CREATE TABLE ring (spot INTEGER, next INTEGER)")
    db.execute("INSERT INTO ring VALUES (5,8),(8,6),(6,7),(7,5),(1,2)")
    union = "WITH RECURSIVE seen(n) AS (SELECT spot FROM ring WHERE spot = 8 UNION SELECT r.next FROM ring r JOIN seen s ON r.spot = s.n) SELECT n FROM seen ORDER BY n"
    assert values(db, union) == [(5,), (6,), (7,), (8,)]
    powers = "WITH RECURSIVE p(n) AS (SELECT 1 AS n UNION ALL SELECT n * 2 FROM p WHERE n < 900) SELECT COUNT(*), MAX(n) FROM p"
    assert values(db, powers) == [(11, 1024)]


def test_updates(harbour):
    r = harbour.execute("UPDATE boats SET crew = crew + 1 WHERE kind = 'yawl' RETURNING no, crew")
    assert r.count == 2 and sorted(map(tuple, r.rows.collect())) == [(11, 4), (14, 3)]
    harbour.execute("UPDATE boats SET port = p.land FROM ports p WHERE boats.port = p.port AND p.depth > 10")
    assert values(harbour, "SELECT no FROM boats WHERE port = 'Greenland'") == [(16,)]
    # A row that meets several takes the least new value.
    harbour.execute("UPDATE ports SET land = b.kind FROM boats b WHERE b.port = ports.port")
    assert sorted(values(harbour, "SELECT port, land FROM ports")) == [("Brest", "France"), ("Lerwick", "ferry"), ("Nuuk", "Greenland"), ("Skagen", "ferry")]
    harbour.execute("UPDATE boats SET crew = 0 WHERE crew > (SELECT MIN(crew) FROM boats) AND port IS NOT NULL")
    assert values(harbour, "SELECT SUM(crew) FROM boats") == [(3,)]


def test_inserts_and_deletes(harbour):
    assert harbour.execute("DELETE FROM boats USING ports WHERE boats.port = ports.port AND ports.land = 'Denmark' RETURNING *").count == 2
    r = harbour.execute("INSERT INTO boats (no, port) VALUES (11, 'Oban'), (30, 'Oban') ON CONFLICT (no) DO NOTHING RETURNING no")
    assert r.fetchall() == [{"no": 30}]
    harbour.execute("INSERT INTO boats (no, port) VALUES (11, 'Kiel'), (31, 'Kiel') ON CONFLICT (no) DO UPDATE SET port = excluded.port, crew = crew * 10")
    assert sorted(values(harbour, "SELECT no, port, crew FROM boats WHERE port = 'Kiel'")) == [(11, "Kiel", 30), (31, "Kiel", None)]
    assert harbour.execute("DELETE FROM boats WHERE crew IS NULL OR no = 12").count == 3
    harbour.execute("CREATE TABLE log (no INTEGER, label TEXT)")
    assert harbour.execute("INSERT INTO log SELECT no, kind FROM boats").count == 3
    assert harbour.execute("TRUNCATE TABLE log").count == 3 and values(harbour, "SELECT * FROM log") == []


def test_many_values(db):
    db.execute("CREATE TABLE m (id INTEGER PRIMARY KEY, label TEXT, size DOUBLE PRECISION, flag BOOLEAN)")
    db.execute("INSERT INTO m VALUES (-1, 'warm', 0, 'yes')")
    began = time.time()
    db.execute("INSERT INTO m VALUES " + ", ".join(f"({i}, 'it''s {i}', {i}.25, 'no')" for i in range(10_000)))
    assert time.time() - began < 15
    assert values(db, "SELECT COUNT(*), MAX(label) FROM m WHERE flag = false") == [(10_000, "it's 9999")]
    # Values of one column may differ in type, and need not be literals.
    db.execute("INSERT INTO m VALUES (-2, 3, NULL, 1), (-3, LOWER('ABC'), 1 + 1, 'f'), (1 - 5, 'x', -2.5, true)")
    assert sorted(values(db, "SELECT label, size FROM m WHERE id < -1"), key=repr) == [("3", None), ("abc", 2.0), ("x", -2.5)]


def test_constraints(db):
    db.execute("CREATE TABLE c (no INTEGER PRIMARY KEY, title TEXT NOT NULL, sign TEXT UNIQUE, state TEXT DEFAULT 'open', weight INTEGER CHECK (weight > 0))")
    db.execute("INSERT INTO c (no, title, sign, weight) VALUES (40, 'north', 'N', 12)")
    assert values(db, "SELECT state FROM c") == [("open",)]
    for bad in ("(40, 'b', 'y', 5)", "(41, NULL, 'y', 5)", "(41, 'b', 'N', 5)", "(41, 'b', 'y', 0)", "(41, 'b', 'y', NULL)", "(42, 'a', 'q', 1), (42, 'a', 'r', 1)"):
        with pytest.raises(ConstraintError):
            db.execute(f"INSERT INTO c (no, title, sign, weight) VALUES {bad}")
    for bad in ("weight = 0", "title = NULL"):
        with pytest.raises(ConstraintError):
            db.execute(f"UPDATE c SET {bad}")
    db.execute("INSERT INTO c (no, title, sign, weight) VALUES (43, 'south', 'S', 1)")
    with pytest.raises(ConstraintError):
        db.execute("UPDATE c SET sign = 'N'")
    assert values(db, "SELECT COUNT(*), SUM(weight) FROM c") == [(2, 13)]


def test_foreign_keys(db):
    db.execute("CREATE TABLE fleet (id INTEGER PRIMARY KEY)")
    db.execute("INSERT INTO fleet VALUES (51), (52), (53), (54)")
    db.execute("CREATE TABLE ship (id INTEGER PRIMARY KEY, fleet INTEGER REFERENCES fleet(id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.execute("CREATE TABLE boat (id INTEGER, ship INTEGER REFERENCES ship(id) ON DELETE SET NULL)")
    db.execute("CREATE TABLE flag (fleet INTEGER REFERENCES fleet(id))")
    db.execute("INSERT INTO ship VALUES (60, 51), (61, 52), (62, NULL)")
    db.execute("INSERT INTO boat VALUES (70, 60), (71, 61)")
    db.execute("INSERT INTO flag VALUES (53)")
    for bad in ("INSERT INTO ship VALUES (63, 59)", "DELETE FROM fleet WHERE id = 53", "DROP TABLE fleet"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    db.execute("DELETE FROM fleet WHERE id = 51")
    assert values(db, "SELECT id, fleet FROM ship ORDER BY id") == [(61, 52), (62, None)]
    assert values(db, "SELECT id, ship FROM boat ORDER BY id") == [(70, None), (71, 61)]
    db.execute("UPDATE fleet SET id = 90 WHERE id = 52")
    assert values(db, "SELECT fleet FROM ship WHERE id = 61") == [(90,)]
    db.execute("DROP TABLE fleet CASCADE")
    db.execute("INSERT INTO ship VALUES (64, 1)")


def test_types(db):
    db.execute("CREATE TABLE t (s SMALLINT, n NUMERIC(10,2), v VARCHAR(5), c CHAR(4), u UUID, b BYTEA, l INTEGER[], f BOOLEAN, d DATE)")
    db.execute("INSERT INTO t VALUES (61.9, 2.675, 'kelp', 'k', '0B5C1D52-6F0E-4C1B-9A55-0DD5B1F0A9C3', '\\x0A', '{4,5}', 'no', '2021-06-30')")
    row = db.sql("SELECT * FROM t").first()
    assert (row.s, str(row.n), row.c, row.l, row.f) == (61, "2.68", "k   ", [4, 5], False)
    assert row.u.startswith("0b5c") and bytes(row.b) == b"\n"
    for column, bad in (("s", "70000"), ("v", "'too long'"), ("u", "'no'"), ("f", "3"), ("d", "'never'")):
        with pytest.raises(Exception):  # noqa: B017
            db.execute(f"INSERT INTO t ({column}) VALUES ({bad})")
    got = values(db, "SELECT CAST('41' AS INTEGER) + 1, CAST(2.5 AS TEXT), '9'::BIGINT, TRIM('\t b '), LENGTH('å'), CEIL(3.1), ROUND(4.5), DATE_PART('dow', '2024-02-29T05:00:00Z')")
    assert got == [(42, "2.5", 9, "b", 1, 4.0, 5.0, 5)]
    assert values(db, "SELECT 'p_q' LIKE 'p\\_q', 'pxq' LIKE 'p\\_q', 'KELP' ILIKE 'k%', 'can''t'") == [(True, False, True, "can't")]


def test_definitions(spark, harbour):
    harbour.execute("CREATE VIEW large AS SELECT no FROM boats WHERE tons > 100")
    assert len(values(harbour, "SELECT * FROM large JOIN boats b ON b.no = large.no")) == 3
    harbour.execute("ALTER TABLE boats RENAME COLUMN crew TO hands")
    harbour.execute("ALTER TABLE boats ADD COLUMN note TEXT")
    harbour.execute("ALTER TABLE boats ALTER COLUMN hands TYPE TEXT")
    assert values(harbour, "SELECT hands, note FROM boats WHERE no = 12") == [("22", None)]
    harbour.execute("UPDATE boats SET note = 'old'")
    harbour.execute("ALTER TABLE boats DROP COLUMN note")
    harbour.execute("ALTER TABLE boats ADD COLUMN note TEXT")
    assert values(harbour, "SELECT DISTINCT note FROM boats") == [(None,)]
    harbour.execute("ALTER TABLE boats ADD CONSTRAINT afloat CHECK (tons > 0)")
    with pytest.raises(ConstraintError):
        harbour.execute("INSERT INTO boats (no, tons) VALUES (80, 0)")
    harbour.execute("ALTER TABLE boats DROP CONSTRAINT afloat")
    harbour.execute("ALTER TABLE boats ALTER COLUMN port SET DEFAULT 'at sea'")
    with pytest.raises(ConstraintError):
        harbour.execute("ALTER TABLE boats ALTER COLUMN port SET NOT NULL")
    harbour.execute("INSERT INTO boats (no, tons) VALUES (80, 0)")
    assert values(harbour, "SELECT port FROM boats WHERE no = 80") == [("at sea",)]
    harbour.execute("ALTER TABLE boats RENAME TO vessels")
    harbour.execute("CREATE SCHEMA inland")
    harbour.execute("CREATE TABLE IF NOT EXISTS inland.t (x INTEGER)")
    harbour.execute("INSERT INTO inland.t VALUES (6)")
    assert values(harbour, "SELECT x FROM inland.t") == [(6,)]
    harbour.execute("DROP VIEW large")
    harbour.execute("DROP TABLE vessels")
    for bad in ("SELECT * FROM vessels", "CREATE SCHEMA inland", "CREATE TABLE ports (x INTEGER)", "SELECT nope FROM ports", "SELECT 1 1"):
        with pytest.raises(Exception):  # noqa: B017
            values(harbour, bad)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("brindle_")]


def test_an_index_orders_the_rows(harbour):
    with pytest.raises(ConstraintError):
        harbour.execute("CREATE UNIQUE INDEX one ON boats (port)")
    harbour.execute("CREATE INDEX by_port ON boats (port, no)")
    harbour.execute("INSERT INTO boats (no, port) VALUES (93, 'b'), (92, 'a'), (91, 'b')")
    harbour.execute("BEGIN")
    harbour.within = lambda action: action()
    harbour.current = harbour.transaction
    for folder in harbour.tables["boats"]["folders"]:
        for part in harbour.store.read([folder], harbour.schema(harbour.tables["boats"])).rdd.glom().collect():
            keys = [(r.port is not None, r.port or "", r.no) for r in part]
            assert keys == sorted(keys)


def test_transactions(spark, db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    other = Session(spark, db.store.root)
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (21)")
    db.execute("SAVEPOINT mark")
    db.execute("INSERT INTO t VALUES (22)")
    assert values(db, "SELECT COUNT(*) FROM t") == [(2,)] and values(other, "SELECT COUNT(*) FROM t") == [(0,)]
    db.execute("ROLLBACK TO SAVEPOINT mark")
    db.execute("COMMIT")
    assert values(other, "SELECT id FROM t") == [(21,)]
    db.execute("BEGIN")
    db.execute("DELETE FROM t")
    other.execute("INSERT INTO t VALUES (23)")
    with pytest.raises(Conflict):
        db.execute("COMMIT")
    db.execute("BEGIN")
    db.execute("DELETE FROM t")
    db.execute("ROLLBACK")
    assert values(db, "SELECT id FROM t ORDER BY id") == [(21,), (23,)]
    assert db.vacuum() > 0 and values(db, "SELECT COUNT(*) FROM t") == [(2,)]
    with pytest.raises(SqlError):
        db.execute("COMMIT")


def test_isolation_and_phantoms(spark, db):
    db.execute("CREATE TABLE a (n INTEGER)")
    db.execute("CREATE TABLE b (n INTEGER)")
    strict, loose = Session(spark, db.store.root), Session(spark, db.store.root, isolation="snapshot")
    for s in (strict, loose):
        s.execute("BEGIN")
        assert values(s, "SELECT COUNT(*) FROM a WHERE n > 5") == [(0,)]
    db.execute("INSERT INTO a VALUES (6)")
    for s in (strict, loose):
        # No phantom: a transaction reads its snapshot.
        assert values(s, "SELECT COUNT(*) FROM a WHERE n > 5") == [(0,)]
        s.execute("INSERT INTO b VALUES (1)")
    with pytest.raises(Conflict):
        strict.execute("COMMIT")
    loose.execute("COMMIT")
    assert values(db, "SELECT (SELECT COUNT(*) FROM a), (SELECT COUNT(*) FROM b)") == [(1, 1)]


def test_commits_merge_behind_other_writers(spark, db, monkeypatch):
    for name in "xyz":
        db.execute(f"CREATE TABLE {name} (n INTEGER)")
    writers = [Session(spark, db.store.root, isolation="snapshot") for _ in range(3)]
    for s, name in zip(writers, "xyz", strict=True):
        s.execute("BEGIN")
        s.execute(f"INSERT INTO {name} VALUES (1)")
    # The first to commit finds two others between its look at the catalogue and its own file.
    latest, left = writers[0].store.latest, writers[1:]

    def interrupted():
        found = latest()
        if left:
            left.pop().execute("COMMIT")
        return found

    monkeypatch.setattr(writers[0].store, "latest", interrupted)
    writers[0].execute("COMMIT")
    assert not left and all(values(db, f"SELECT n FROM {name}") == [(1,)] for name in "xyz")
