"""WARC archives: an exact round trip, and the merged order against a sort."""

import base64
import gzip
import hashlib
import random

from brindle.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


ROWS = [
    (1, "http://www.Example.com:80/a?b=1#c", "<p>one</p>"),
    (2, "https://example.com/a", "<p>two</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx"),
    (3, "http://b.org", "<p>one</p>"),
    (4, None, None),
    (5, "http://b.org/\r\nX: y", ""),
    (6, "http://b.org/é", "é" * 100_000),
    (7, "http://b.org/é", "é" * 100_000),
    (7, "http://b.org/é", "é" * 100_000),
    (None, "http://c.org", "<p>one</p>"),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    index, order = warc.archive(df, str(tmp_path / "a"))
    first = {}
    for i, _, h in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in ROWS:
        h = h or ""
        again = i is not None and first[h] != i
        want.append((str(i or ""), digest(h), len(h.encode()), "revisit" if again else "response", str(first[h]) if again else None))
    columns = ("id", "payload_digest", "payload_bytes", "record_type", "refers_to")
    for found in (index, order):
        assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(want, key=str)
    _, large = warc.archive(df, str(tmp_path / "b"), least_bytes=1000)
    assert sorted(r.id for r in large.where("record_type = 'revisit'").collect()) == ["7", "7"]


def test_blocks_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    index, _ = warc.archive(df, str(tmp_path / "a"))
    blocks = []
    files = {f.name: f.read_bytes() for f in (tmp_path / "a").glob("part-*")}
    for content in files.values():
        # Any gzip reader can read the whole file.
        blocks += [(h["warc-record-id"], b.decode()) for _, h, b in warc.parse([gzip.decompress(content)])]
        assert blocks == [(h["warc-record-id"], b.decode()) for _, data in warc.members(content, piece=100) for _, h, b in warc.parse([data])]
    assert ("<urn:capture:2>", ROWS[1][2]) in blocks and ("<urn:capture:6>", ROWS[5][2]) in blocks
    # One record by its offset.
    for r in index.collect():
        headers, block = warc.read_record(files[r.archive], r.offset)
        assert headers["warc-record-id"] == f"<urn:capture:{r.id}>" and (r.record_type == "revisit" or len(block) == r.payload_bytes)


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=500))) for i in range(50)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert len(sizes) > 10 and max(sizes) < 3000


def test_order_is_global(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(3) if i % 3 else 0}.org/{rng.randrange(5) if i % 2 else 'hot'}", f"{i}", rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at long").repartition(4)
    _, order = warc.archive(df, str(tmp_path / "a"), time_col="at")
    got = [(r.url_key, r.time, r.id) for r in order.orderBy("part", "position").collect()]
    assert len(got) == 300 and got == sorted(got)
    assert order.select("part").distinct().count() > 2


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], 1)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("http://www.Example.com:80/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("https://example.com") == "com,example)/"
    assert warc.url_key(None) == ")/"


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index, order = warc.archive(df, str(tmp_path / "a"))
    assert index.count() == 0 and order.count() == 0
