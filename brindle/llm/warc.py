"""WARC archives: records written and read back, and capture histories merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import scratch_path, table, written

CRLF = "\r\n"
RECORD_END = CRLF * 2
#: Compressed bytes after which an archive file ends; a reading task holds one file.
ARCHIVE_BYTES = 8 << 20
#: A gzip member without content, which ends each file.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300" + "00" * 8)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in one merged range, about.
RANGE_ROWS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIRST_CAPTURE = 1_704_067_200  # 2024-01-01T00:00:00Z


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, no scheme, www, default port or fragment, in lower case."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip()).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, mark, query = host.partition("?")
    host = re.sub(r":(80|443)$", "", host.lower().rpartition("@")[2])
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (slash + path if slash else "/") + mark + query


def _digest(payload: Column) -> Column:
    """Base32 of the payload's SHA-1: each 5 hexadecimal digits are 4 letters."""

    def letters(at: Column) -> Column:
        bits = F.conv(F.substring(F.sha1(payload), at * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])

    return F.concat(*[letters(F.lit(i)) for i in range(8)])


def _header(name: str, value: Column) -> Column:
    """One header line, left out if the value is null; line breaks in a value would end it and become blanks."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def decide(pages: DataFrame, id_col: str, url_col: str, payload_col: str, time_col: str | None, least_bytes: int) -> DataFrame:
    """pages as captures: id, url, payload (null: empty), bytes, digest, time (epoch seconds) and ``original``.

    original is the smallest id of the same payload digest, null where the capture is that one or
    its payload is smaller than least_bytes. Digests are grouped without payloads, map-side first.
    """
    time = F.col(f"`{time_col}`").cast("long") if time_col else F.lit(FIRST_CAPTURE).cast("long")
    captures = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"),
        F.coalesce(time, F.lit(FIRST_CAPTURE)).alias("time"),
    ).withColumn("bytes", F.octet_length("payload").cast("long"))
    hashed = captures.withColumn("digest", _digest(F.col("payload")))
    narrow = written(hashed.select("id", "digest", "bytes"), "digests")
    first = narrow.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    again = narrow.join(first.where("n > 1"), "digest").where("id <> least").select("id", "digest", "least").distinct()
    again = again.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("digest", "least"))).alias("originals"))
    joined = hashed.join(again, "id", "left")
    return joined.withColumn("original", F.try_element_at("originals", "digest")).drop("originals")


def records(captures: DataFrame) -> DataFrame:
    """Captures as WARC/1.1 records in one string column."""
    stamp = F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("original").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", stamp),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:capture:"), F.col("original").cast("string"), F.lit(">")))),
        _header("X-Payload-Length", F.col("bytes")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(body)),
        F.lit(CRLF),
    )
    return captures.select(F.concat(head, body, F.lit(RECORD_END)).alias("value"))


def _archives(least_size: int):
    """Records compressed one by one, least_size bytes or a little more in a row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for record in batch.column(0):
                member = zlib.compressobj(wbits=31)
                held += [member.compress(record.as_py().encode()), member.flush()]
                size += len(held[-1]) + len(held[-2])
                if size >= least_size:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return of


def write_archives(captures: DataFrame, path: str) -> None:
    """Archives under path: a gzip member for each record, so that one can be read by its offset alone.

    Spark's text writer writes the bytes of each row to a file of its own and commits files whole, so
    that a lost executor leaves no half archive and any file system will do. What it writes behind a row is an empty member.
    """
    rows = records(captures).mapInArrow(_archives(ARCHIVE_BYTES), "value binary").select(F.col("value").cast("string"))
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def members(content: bytes, at: int = 0, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member of a file from one that begins at ``at``; empty ones are left out."""
    view = memoryview(content)
    while at < len(view):
        begin, member, out = at, zlib.decompressobj(wbits=31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a gzip member")
            out.append(member.decompress(view[at : at + piece]))
            at = min(at + piece, len(view))
        at -= len(member.unused_data)
        if data := b"".join(out):
            yield begin, data


def read_record(content: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record whose member begins at ``offset``."""
    _, data = next(members(content, offset))
    _, headers, block = next(parse([data]))
    return headers, block


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers by lower-case name, block) of each record, cut by Content-Length, whatever blocks hold."""
    buffer, offset, source = bytearray(), 0, iter(pieces)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(source, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(1):
        end, seen = -1, 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("the archive ends inside a header")
        lines = buffer[:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(headers["content-length"])
        if not fill(size + len(RECORD_END)):
            raise ValueError("the archive ends inside a record")
        if buffer[size : size + len(RECORD_END)] != RECORD_END.encode():
            raise ValueError(f"the record at {offset} has another length")
        yield offset, headers, bytes(buffer[end + 4 : size])
        del buffer[: size + len(RECORD_END)]
        offset += size + len(RECORD_END)


INDEX = (
    "url_key string, time string, id string, archive string, offset long, url string, record_type string, refers_to string, "
    "payload_digest string, payload_bytes long, block_digest string, block_bytes long"
)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bare = lambda x: x.removeprefix("<urn:capture:").removesuffix(">") if x is not None else None
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in INDEX.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, name = [], path.as_py().rpartition("/")[2]
            for offset, data in members(content.as_py()):
                for _, h, block in parse([data]):
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    url = h.get("warc-target-uri")
                    rows.append((
                        url_key(url), h["warc-date"], bare(h["warc-record-id"]), name, offset, url, h["warc-type"], bare(h.get("warc-refers-to")),
                        h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"]), digest, len(block),
                    ))
            rows.sort(key=lambda r: r[:MERGE_KEYS])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row for each record of the archives under path, each archive's in order of url_key, time, id and offset.

    An archive's offsets are those of its gzip members. Raises where a response's payload isn't what its header says.
    """
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
        index = written(files.mapInArrow(_indexed, INDEX), "index")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wrong = (F.col("record_type") == "response") & ((F.col("payload_digest") != F.col("block_digest")) | (F.col("payload_bytes") != F.col("block_bytes")))
    if not index.where(wrong).isEmpty():
        raise ValueError("a payload read back differs from its digest")
    return index.drop("block_digest", "block_bytes")


#: The first so many columns are the order.
MERGE_KEYS = 5


class LoserTree:
    """k sorted runs merged: rows compare by their first columns. Inner nodes keep the loser of each match, so that the next winner takes log k matches."""

    def __init__(self, runs: list[Iterator], keys: int):
        self.runs = runs
        self.keys = keys
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._rise(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[: self.keys], a) < (y[: self.keys], b)

    def _rise(self, run: int, building: bool = False) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self.losers[node] < 0 and building:
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        if not self.k:
            return
        while (head := self.heads[self.winner]) is not None:
            yield head
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            self._rise(run)


CAPTURE = "url_key string, time string, id string, archive string, offset long, record_type string, refers_to string, payload_digest string, payload_bytes long"
HISTORY = f"part int, position long, {CAPTURE}"
_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]
_capture = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in CAPTURE.split(", ")])


def _runs(borders: list[tuple]):
    """(part, run) rows from captures: sorted stretches of them, cut at the borders, each as one serialised table.

    Captures come as they were written, archive by archive. Where one is less than that before it a new run begins.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _capture, strict=True)], schema=_capture)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _capture) as out:
                out.write_table(table, max_chunksize=1024)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "run"])

        for batch in batches:
            for capture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = capture[:MERGE_KEYS]
                if held and (key < held[-1][:MERGE_KEYS] or (part < len(borders) and key >= borders[part])):
                    yield row()
                    held = []
                if not held:
                    part = bisect_right(borders, key)
                held.append(capture)
        if held:
            yield row()

    return of


def _merged(key, held):
    """One range of the order: its runs, merged."""

    def rows(run: bytes) -> Iterator[tuple]:
        for chunk in pa.ipc.open_stream(run):
            yield from zip(*(c.to_pylist() for c in chunk.columns), strict=True)

    tables, out, position = [], [], 0

    def flush() -> None:
        cells = [pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(range(position - len(out), position), pa.int64())]
        cells += [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _capture, strict=True)]
        tables.append(pa.Table.from_arrays(cells, names=["part", "position", *_NAMES]))

    for row in LoserTree([rows(r.as_py()) for r in held["run"]], MERGE_KEYS):
        out.append(row)
        position += 1
        if len(out) == 4096:
            flush()
            out = []
    if out:
        flush()
    return pa.concat_tables(tables)


def histories(index: DataFrame) -> DataFrame:
    """All captures in global order of url_key, time, id, archive, offset: by part, then position.

    Each archive's captures are a run, sorted where it was read. The order is cut in ranges of about RANGE_ROWS captures; in every
    range the runs' pieces meet and are merged by a loser tree, which alone orders them. What reaches the driver is one
    border for each range.
    """
    keys = _NAMES[:MERGE_KEYS]
    ranges = max(1, -(-index.count() // RANGE_ROWS))
    borders = []
    if ranges > 1:
        dealt = index.select(*keys).repartitionByRange(ranges, *keys)
        least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("least"))
        borders = sorted(tuple(r.least) for r in least.collect())[1:]
    runs = index.select(*_NAMES).mapInArrow(_runs(borders), "part int, run binary")
    return runs.groupBy("part").applyInArrow(_merged, HISTORY)


def archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, *, least_bytes: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Write pages as WARC archives under path and read them back: (index, capture histories).

    Of captures of equal payloads of at least least_bytes bytes, that of the smallest id is a response
    and the others are revisits that refer to it; smaller payloads are all responses. A null payload is
    empty, a null address has no header, a null time is FIRST_CAPTURE; captures of a null id are responses
    with an empty record id. Repeated rows give repeated records; those of one id and payload stay of one kind. An empty
    table gives no records. Other columns of pages are not read.
    """
    spark = pages.sparkSession
    write_archives(decide(pages, id_col, url_col, payload_col, time_col, least_bytes), path)
    index = read_archives(spark, path)
    return index, histories(index)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    _, captures = archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return captures.select(
        F.col("id").try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages
), d AS (SELECT page_id, f, strlen(h) AS n, sha1(h) AS x FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""
