"""Commands on keys."""

import pytest

from brindle.session import Session
from brindle.sources import keyvalue
from brindle.sources.keyvalue import WrongType


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyvalue, "MERGE_AT", 6)
    db = Session(spark, str(tmp_path / "kv"))
    kv = db.kv
    assert kv.get("a") is None
    kv.set("a", "1")
    kv.set("a", "2")
    assert kv.get("a") == "2"
    assert kv.lpush("l", "oak", "elm") == 2 and kv.rpush("l", "fir") == 3
    assert kv.lrange("l", 0, -1) == ["elm", "oak", "fir"] and kv.llen("l") == 3 and kv.lrange("l", -2, 9) == ["oak", "fir"]
    assert kv.lpop("l") == "elm" and kv.rpop("l", 5) == ["fir", "oak"] and kv.lpop("l") is None and kv.llen("l") == 0
    assert kv.sadd("s", "tin", "zinc", "lead") == 3 and kv.sadd("s", "zinc", "iron") == 1 and kv.scard("s") == 4
    assert kv.srem("s", "tin", "gold") == 1 and kv.smembers("s") == ["iron", "lead", "zinc"] and kv.sismember("s", "lead") == 1
    with pytest.raises(WrongType):
        kv.lpush("s", "x")
    with pytest.raises(WrongType):
        kv.get("s")
    kv.json_set("user:1", '{"name": "Ann", "age": 30, "at": {"city": "SF"}}')
    kv.json_set("user:2", '{"name": "Bob", "age": 25}')
    kv.json_set("user:2.at.city", '"NY"')
    assert kv.json_get("user:2.at.city") == '"NY"' and kv.json_get("user:2.no") is None
    assert kv.json_del("user:1.age") == 1 and kv.json_del("user:1.age") == 0
    got = [tuple(r) for r in db.sql("SELECT id, name, age, at.city AS city FROM user ORDER BY id").collect()]
    assert got == [("1", "Ann", None, "SF"), ("2", "Bob", 25, "NY")]
    assert sorted(r.key for r in kv.keys("u?er:*").collect()) == ["user:1", "user:2"]
    assert kv.delete("a", "user:1", "nope") == 2 and kv.get("a") is None
    db.execute("BEGIN")
    kv.set("t", "x")
    db.execute("ROLLBACK")
    assert kv.get("t") is None
    db.flush()
    assert kv.keys().count() == 0
