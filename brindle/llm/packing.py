"""Packing: documents as token ids, cut and packed into windows by multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.llm.common import give_back, table

TOKENIZER = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Windows that one differencing fills; bounds a task's memory and the share of padding (about one window in so many).
BATCH_WINDOWS = 256
#: What is left of a document is cut into this many pieces a window at least, for windows of several pieces balance best.
CUTS = 4
#: Words whose ids a task keeps.
CACHE_WORDS = 400_000
ID_BYTES = 4
END = END_ID.to_bytes(ID_BYTES, "little")
#: Stands for the end-of-word mark; no UTF-8 text holds this byte.
WORD_END = b"\xff"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids (4 bytes each, little-endian) of each white-space separated word, as the tokenizer gives them.

    The tokenizer drops white space and never joins across it, so that a text's ids are those of
    its words in turn. Words of Latin letters, digits and ASCII marks go to a faster BPE with the same merges;
    all others, and any that may hold a special token, to the tokenizer itself.
    """

    simple = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, suffix = _byte_letters(), model["end_of_word_suffix"]
        ranks = {}
        for token, rank in model["vocab"].items():
            if token.startswith("<|"):
                continue
            ends = token.endswith(suffix) and token != suffix
            body = bytes(letters[c] for c in (token[: -len(suffix)] if ends else token))
            ranks[body + WORD_END * ends] = rank
        self.bpe = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.piece_ids: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(ID_BYTES, "little") for i in ids)

    def piece(self, piece: str) -> bytes:
        found = self.piece_ids.get(piece)
        if found is None:
            ids = self.bpe.encode_single_piece(piece.encode() + WORD_END)
            found = b"".join([i.to_bytes(ID_BYTES, "little") for i in ids])
            if len(self.piece_ids) < CACHE_WORDS:
                self.piece_ids[piece] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.simple.fullmatch(text):
            low = text.lower()
            if low.isalpha():
                found = self.piece(low)
            elif low[:-1].isalpha() and not low[-1].isalnum():
                found = self.piece(low[:-1]) + self.piece(low[-1])
            else:
                found = b"".join(map(self.piece, self.pieces.findall(low)))
        else:
            found = self.whole(text)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """Ids of a text (null: none), with the end id."""
        text = text or ""
        if "<|" in text:
            return self.whole(text) + END
        if not unicodedata.is_normalized("NFC", text):
            return self.whole(text) + END
        return b"".join(map(self.__getitem__, text.encode().split())) + END


def difference(sizes: list[int], windows: int) -> tuple[list[list[int]], int]:
    """Karmarkar-Karp: items by window, and the largest window's size.

    Each item starts as a partition of its own. The two partitions of the largest spread merge,
    the fullest windows of one with the emptiest of the other, until one is left.
    """
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, (i,))]))
    heapq.heapify(heap)
    count = len(sizes)
    floor = 0
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Windows are kept in falling order and those of size 0 are left out.
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:
            keep_a, keep_b = len(a) - over, len(b) - over
            merged = a[:keep_a] + b[:keep_b]
            merged += [(x + y, (p, q)) for (x, p), (y, q) in zip(a[keep_a:], reversed(b[keep_b:]), strict=True)]
        merged.sort(key=lambda w: -w[0])
        if len(merged) == windows and (least := merged[-1][0]):
            floor += least
            merged = [(x - least, p) for x, p in merged]
        count += 1
        heapq.heappush(heap, (-merged[0][0], count, merged))
    final = heap[0][2]
    return [_flat(p) for _, p in final] + [[] for _ in range(windows - len(final))], final[0][0] + floor


def _flat(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def windows_of(sizes: list[int], window: int) -> list[list[int]]:
    """Items (none larger than a window) by window; one window more whenever the fullest is over capacity."""
    if not sizes:
        return []
    n = max(1, -(-sum(sizes) // window))
    while True:
        found, most = difference(sizes, n)
        if most <= window:
            return [w for w in found if w]
        n += 1


FIELDS = pa.schema(
    [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def _packed(batches: Iterator, path: str, window: int, with_ids: bool, id_type: pa.DataType) -> Iterator:
    words = WordIds(path)
    sequence = TaskContext.get().partitionId() << 40
    schema = pa.schema([("id", id_type), *FIELDS, *([("ids", pa.binary())] if with_ids else [])])
    full: list[tuple] = []
    rest: list[tuple] = []
    waiting = 0

    def piece(doc, ids: bytes, start: int, length: int) -> tuple:
        part = ids[start * ID_BYTES : (start + length) * ID_BYTES]
        return doc, start, length, zlib.crc32(part), len(ids) // ID_BYTES, part if with_ids else None

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*[(*r[:5], r[6], r[7], r[5]) for r in rows], strict=True))[: len(schema)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    def flush() -> Iterator:
        nonlocal sequence, waiting
        rows = full.copy()
        for members in windows_of([r[2] for r in rest], window):
            offset = 0
            for i in members:
                rows.append((*rest[i], sequence, offset))
                offset += rest[i][2]
            sequence += 1
        full.clear()
        rest.clear()
        waiting = 0
        if rows:
            yield table_of(rows)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.ids(text.as_py())
            n = len(ids) // ID_BYTES
            for start in range(0, n - window + 1, window):
                full.append((*piece(doc, ids, start, window), sequence, 0))
                sequence += 1
            for start in range(n - n % window, n, max(1, window // CUTS)):
                rest.append(piece(doc, ids, start, min(max(1, window // CUTS), n - start)))
            waiting += n % window
            if waiting >= BATCH_WINDOWS * window or len(full) >= 4 * BATCH_WINDOWS:
                yield from flush()
    yield from flush()
    del words
    give_back()


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, *, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens; ``tokenizer`` is a file's path.

    Per piece: the id, start and length in its document's ids, ids_crc32, doc_tokens, sequence_id,
    offset in the sequence and, with_ids, the ids themselves (4 bytes each, little-endian). A
    document's whole windows stand alone; what is left of the documents of a task is packed, some
    BATCH_WINDOWS windows at a time. A null or empty text is the end id alone; repeated rows are packed
    as often as they occur; ids may be of any type; an empty table gives no pieces; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind, timestamp_utc=True)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids binary" if with_ids else ""
    packed = source.mapInArrow(lambda batches: _packed(batches, tokenizer, window, with_ids, id_type), schema)
    return packed.withColumnRenamed("id", id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), with_ids=False)
