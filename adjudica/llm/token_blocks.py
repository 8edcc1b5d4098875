"""Operator 8, token ids in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by the order columns, encoded with the tokenizers library, and written as
shards: binary values in a Parquet table in the shared folder, so that Spark's committer handles lost executors. A
shard holds whole documents; a block holds BLOCK ids of a shard: their minimum is subtracted, the rest is packed at the
width that fits PERCENTILE per cent of them, and larger values are in the block's exception list.

Shard, little-endian:
  magic PFR1, u32 documents, u32 blocks, u64 ids
  document table: i64 id, u8 whether the id isn't null, u64 number of ids, each as one array
  block index: u64 byte offset of each block from the first block's start
  blocks: u32 minimum, u8 width, u16 exceptions, packed words (u64), exception positions (u16), exception values (u32)

Defined results: a null or empty text holds the end id alone. Rows of the same id keep their text order. A null id
sorts first. An empty table gives no shard and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, on_release, store, task

BLOCK = 512
PERCENTILE = 90
#: Ids after which a shard is closed at the next document's end.
SHARD_IDS = 1 << 17
#: Encoded pieces that a worker remembers in each of two generations.
MEMO = 450_000
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIIQ")

#: A space between two characters that aren't white space: the byte-level pre-tokenizer always starts a piece there.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: So it does around a newline.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: Letters, digits and other characters are pieces of their own, but for endings after an apostrophe.
_RUNS = re.compile("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
#: White space other than spaces and newlines, and what a plain split at spaces would cut wrongly.
_ODD = ["  ", " \n", "\n "] + [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_ODD_ASCII = [x for x in _ODD if x.isascii()]


def cut(text: str) -> list[str]:
    """The text's parts between seams; a plain split where the text has no odd white space."""
    if text[:1] == " " or text[-1:] == " " or any(map(text.__contains__, _ODD_ASCII if text.isascii() else _ODD)):
        return _SEAM.split(text)
    return text.split(" ")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """values: (blocks, BLOCK) uint64 below 2**width; to (blocks, BLOCK * width / 64) words."""
    n = len(values)
    lanes = values.reshape(n, BLOCK // 64, 64)
    words = np.zeros((n, BLOCK // 64, width), np.uint64)
    for i in range(64 if width else 0):
        word, off = divmod(i * width, 64)
        words[:, :, word] |= lanes[:, :, i] << np.uint64(off)
        if off + width > 64:
            words[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - off)
    return words.reshape(n, -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    out = np.zeros((n, BLOCK // 64, 64), np.uint64)
    if width:
        words = words.reshape(n, BLOCK // 64, width)
        mask = np.uint64((1 << width) - 1)
        for i in range(64):
            word, off = divmod(i * width, 64)
            x = words[:, :, word] >> np.uint64(off)
            if off + width > 64:
                x = x | (words[:, :, word + 1] << np.uint64(64 - off))
            out[:, :, i] = x & mask
    return out.reshape(n, BLOCK)


def encode_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    n = -(-len(ids) // BLOCK)
    last = ids[-1] if len(ids) else 0
    v = np.full(n * BLOCK, last, np.uint32)
    v[: len(ids)] = ids
    v = v.reshape(n, BLOCK)
    low = v.min(1)
    d = v - low[:, None]
    at = max(0, -(-BLOCK * PERCENTILE // 100) - 1)
    width = _widths(np.partition(d, at, axis=1)[:, at])
    body: list[bytes] = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = d[rows].astype(np.uint64)
        over = part >> np.uint64(w) != 0
        words = pack(part & np.uint64((1 << int(w)) - 1), int(w)).astype("<u8")
        counts = over.sum(1)
        pos = np.nonzero(over)[1].astype("<u2")
        val = part[over].astype("<u4")
        ends = np.cumsum(counts)
        for k, row in enumerate(rows):
            a, b = ends[k] - counts[k], ends[k]
            body[row] = struct.pack("<IBH", low[row], w, counts[k]) + words[k].tobytes() + pos[a:b].tobytes() + val[a:b].tobytes()
    offsets = np.cumsum([0, *map(len, body)])[:-1].astype("<u8")
    ok = np.array([x is not None for x in doc_ids], np.uint8)
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + ok.tobytes() + np.array(lengths, "<u8").tobytes()
    return _HEAD.pack(MAGIC, len(doc_ids), n, len(ids)) + table + offsets.tobytes() + b"".join(body)


def decode_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids."""
    magic, docs, n, total = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a shard of this format")
    at = _HEAD.size
    doc_ids = np.frombuffer(blob, "<i8", docs, at)
    ok = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(blob, "<u8", docs, at + 9 * docs)
    at += 17 * docs
    offsets = np.frombuffer(blob, "<u8", n, at).astype(np.int64)
    at += 8 * n
    heads = [struct.unpack_from("<IBH", blob, at + o) for o in offsets]
    out = np.empty((n, BLOCK), np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        size = BLOCK * int(w) // 8
        raw = b"".join(blob[at + offsets[r] + 7 : at + offsets[r] + 7 + size] for r in rows)
        d = unpack(np.frombuffer(raw, "<u8").reshape(len(rows), -1), int(w))
        for k, r in enumerate(rows):
            if c := heads[r][2]:
                p = at + offsets[r] + 7 + size
                d[k, np.frombuffer(blob, "<u2", c, p)] = np.frombuffer(blob, "<u4", c, p + 2 * c)
        out[rows] = (d + np.array([heads[r][0] for r in rows], np.uint64)[:, None]).astype(np.uint32)
    return [int(x) if k else None for x, k in zip(doc_ids, ok, strict=True)], lengths.astype(np.int64), out.reshape(-1)[:total]


def _u4(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Memo(dict):
    """What encode gives for a piece, remembered in two generations."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece) or self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """Ids of a text as little-endian u32 bytes.

    Texts are cut only where the byte-level pre-tokenizer always cuts, so the pieces' ids are the text's: before a single
    space between other characters, around a single newline between other characters, and between letters and the
    punctuation that ends a piece. What the tokenizer gives for a piece is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced, self.bare = Memo(self.after_space), Memo(self.plain)
        self.newline = self.whole("\n")
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = dict(zip([*shown, *hidden], map(chr, [*shown, *range(256, 256 + len(hidden))]), strict=True))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packed = [_u4([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.one_piece = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and self.tokenizer.normalizer is None

    def whole(self, text: str) -> bytes:
        return _u4(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, text: str, before: str = "") -> bytes:
        """Of letters, after a space (before: how the model shows it) or not: always one piece, so the model can be asked at once."""
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(before + shown)])

    def after_space(self, piece: str) -> bytes:
        if self.one_piece and piece.isalpha():
            return self.word(piece, "\u0120")
        return self.parts(piece, self.spaced) or self.whole(" " + piece)

    def plain(self, piece: str) -> bytes:
        if self.one_piece and piece.isalpha():
            return self.word(piece)
        return self.parts(piece, self.bare) or self.whole(piece)

    def parts(self, piece: str, memo: Memo) -> bytes | None:
        """The ids of a piece from its parts' in the memos, or None if it has none. The piece neither begins nor ends with white space."""
        if "\n" in piece:
            head, *lines = piece.split("\n")
            if all(x.split() == [x] for x in (head, *lines)):
                return memo[head] + b"".join(self.newline + self.bare[x] for x in lines)
            return None
        stem = piece.rstrip(".,;:!?")
        if stem != piece and stem.isalpha():
            return memo[stem] + self.bare[piece[len(stem) :]]
        if self.one_piece and piece.isascii() and "'" not in piece and piece.split() == [piece]:
            first, *rest = _RUNS.findall(piece)
            return memo[first] + b"".join(map(self.bare.__getitem__, rest)) if rest else None
        return None

    def line(self, text: str) -> bytes:
        first, *rest = cut(text)
        head = self.bare[first] if first.split() == [first] else self.whole(first)
        return head + b"".join(map(self.spaced.__getitem__, rest)) if rest else head

    def __call__(self, text: str) -> bytes:
        """Line by line where a single newline stands between other characters, so that words around it aren't remembered
        in pairs. An added token is an id of its own wherever it stands, so a text that has one isn't cut."""
        if any(map(text.__contains__, self.added)):
            return self.whole(text)
        return self.newline.join(map(self.line, _LINE.split(text))) if "\n" in text else self.line(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


on_release(encoder.cache_clear)


def _path(tokenizer: str) -> str:
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return str(public_tokenizers.path(tokenizer))


SHARDS = "part int, seq int, n_ids long, blob binary"


def shards(docs: DataFrame, order: list[str], tokenizer: str, end_id: int) -> DataFrame:
    """One row for each shard, in the order of (part, seq)."""

    @task(__name__)
    def write(rows):
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, chunks, size = [], [], [], 0
        encode, end = encoder(_path(tokenizer)), np.array([end_id], "<u4").tobytes()

        def row():
            nonlocal ids, lengths, chunks, size, seq
            blob = encode_shard(ids, lengths, np.frombuffer(b"".join(chunks), "<u4"))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_ids", "blob"])
            ids, lengths, chunks, size, seq = [], [], [], 0, seq + 1
            return out

        for batch in batches(rows):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                got = encode(text.as_py() or "")
                ids.append(doc)
                lengths.append(len(got) // 4 + 1)
                chunks += [got, end]
                size += lengths[-1]
                if size >= SHARD_IDS:
                    yield row()
        if ids:
            yield row()

    placed = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, SHARDS)


def read_back(table: DataFrame) -> DataFrame:
    """From the stored shards: a row for each document with its start, number of ids and checksum."""

    @task(__name__)
    def read(rows):
        for batch in batches(rows):
            for part, seq, blob in zip(*(batch.column(c) for c in ("part", "seq", "blob")), strict=True):
                doc_ids, lengths, ids = decode_shard(blob.as_py())
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                k = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"])

    docs = table.select("part", "seq", "blob").mapInArrow(read, "part int, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    # Bases in two steps, so that the window that spans everything has a row for each partition, not for each shard.
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_base"))
    own = Window.partitionBy("part").orderBy("seq")
    inner = table.select("part", "seq", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("_in"))
    bases = inner.join(base, "part").select("part", "seq", (F.col("_base") + F.col("_in")).alias("_base"))
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(spark: SparkSession, docs: DataFrame, order: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, scope: str = "op") -> DataFrame:
    """Encodes, writes the shards, reads them back: doc_id, start, n_tokens, ids_crc32. tokenizer: a file of public_tokenizers or a path."""
    needed = docs.select(*dict.fromkeys((*order, "doc_id", "text")))
    return read_back(store(spark, shards(needed, list(order), tokenizer, end_id), "shards", scope))
