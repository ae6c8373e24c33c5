"""Token-ID output: binary files of all documents' ids in ascending order, coded by a static range numeral system.

Documents are tokenised where they are read. Counts of all ids make one frequency table, which every block shares. Then
documents are dealt into ranges of ids (shards), sorted, and each shard's ids are cut into blocks that are coded
independently (see `rans`): a block decodes without the others, and from any of its checkpoints.

The folder holds `table` (the frequency table) and `blocks`, one record a block: shard, number, the ids before it in the
shard, the coded bytes, and the pieces of documents in it. Records are written through Spark's own writer, so that they
go to any file system that Spark knows and only those of finished tasks count; a lost executor costs its open tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import cut, release, scratch, small, tuned
from .packing import ByteBpe

END_ID = 2
#: Ids of a block, blocks coded at once, ids planned for a shard, and most shards (beyond which they grow).
BLOCK, TOGETHER, SHARD_IDS, MAX_SHARDS = 1 << 16, 48, 1 << 22, 100_000
#: Words whose ids a worker keeps.
CACHE = 1_000_000
_SPACE = re.compile(r"(?<=\S) (?=\S)")
PIECE = "array<struct<doc_id: long, start: long, total: long, at: int, length: int>>"


class Encoder:
    """Ids of a tokenizers file, equal to the library's own for whole texts; each word is encoded once.

    The byte-level pattern always parts a text at a single space between characters that aren't white space. So such words
    are known by their ids, and new ones are encoded many at a time, from the ranks of the same vocabulary where these lie
    beside the file (see `packing.ByteBpe`), else by the library; byte lengths tell them apart again. Texts that name a
    special token, and tokenizers of other kinds, are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.words = Tokenizer.from_file(path), ByteBpe(path)
        pre = spec.get("pre_tokenizer") or {}
        self.parted = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=-1) + 1
        self.kind = np.dtype("<u2" if max(self.size, END_ID + 1) <= 1 << 16 else "<u4")
        self.width = np.zeros(self.size, np.int64)  # a character of a byte-level token is a byte
        for t, i in vocabulary.items():
            self.width[i] = len(t)
        self.inner: dict[str, bytes | bool] = {"": False}  # False: no word
        self.first: dict[str, bytes | bool] = {"": b""}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _apart(self, words: list[str], lead: str, known: dict) -> None:
        """Encodes words as one text in which each follows lead, and keeps their ids without that of a line feed."""
        text = lead.join(["", *words])
        ids, raw = self.words(text).astype(self.kind), np.frombuffer(text.encode(), np.uint8)
        start = np.flatnonzero(raw == ord(lead))
        if len(start) > len(words):  # leads inside of words
            start = np.cumsum([0, *(len(w.encode()) + 1 for w in words[:-1])])
        ends = np.cumsum(self.width[ids])
        stop = np.append(start[1:], len(raw))
        last = np.searchsorted(ends, stop) + 1
        if not np.array_equal(ends[last - 1], stop):
            raise ValueError("a word's bytes are parted otherwise than expected")
        first = np.concatenate(([0], last[:-1])) + (lead == "\n")
        raw, w = ids.tobytes(), self.kind.itemsize
        known.update(zip(words, [raw[a:b] for a, b in zip((first * w).tolist(), (last * w).tolist(), strict=True)], strict=True))

    def _learn(self, words: set[str], lead: str, known: dict) -> None:
        new = [w for w in words if w and w.strip() == w]
        if len(new) < len(words):  # not words: their texts are parted anew
            known.update((w, False) for w in words if w and w.strip() != w)
        for lo in range(0, len(new), 20_000):
            self._apart(new[lo : lo + 20_000], lead, known)

    def _odd(self, text: str) -> bytes:
        """Ids of a text with other white space than single spaces."""
        words = _SPACE.split(text)
        out = []
        for lead, group, known in (("\n", words[:1], self.first), (" ", words[1:], self.inner)):
            self._learn({w for w in group if w not in known}, lead, known)
            for w in group:
                x = known[w]
                out.append(x if x is not False else self._whole([(" " if lead == " " else "") + w])[0].tobytes())
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        texts = [t or "" for t in texts]
        if not self.parted:
            return self._whole(texts)
        for known, empty in ((self.inner, False), (self.first, b"")):
            if len(known) > CACHE:
                known.clear()
                known[""] = empty
        parted, open_, new = [], [], set()
        for t in texts:
            if any(s in t for s in self.special):
                parted.append(None)
                continue
            words = t.split(" ")
            ids = list(map(self.inner.get, words))
            ids[0] = self.first.get(words[0])
            parted.append(ids)
            if None in ids:
                at = [i for i, x in enumerate(ids) if x is None]
                open_.append((ids, words, at))
                new.update(words[i] for i in at if i)
        self._learn({words[0] for _, words, at in open_ if at[0] == 0}, "\n", self.first)
        self._learn(new, " ", self.inner)
        for ids, words, at in open_:
            for i in at:
                ids[i] = self.inner[words[i]] if i else self.first[words[0]]
        out = []
        for t, ids in zip(texts, parted, strict=True):
            if ids is None:
                out.append(self._whole([t])[0])
                continue
            try:
                raw = b"".join(ids)
            except TypeError:  # a part that is no word
                raw = self._odd(t)
            out.append(np.frombuffer(raw, self.kind))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, which keeps its words (at most CACHE) from task to task."""
    return Encoder(path)


def _tokens(path: str, end_id: int):
    def run(batches):
        encoder = _encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            ids = [x.tobytes() + end for x in encoder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(ids, pa.binary())], ["doc_id", "tie", "ids"])
        release()
    return run


def _counts(kind: np.dtype):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            if len(c) > len(total):
                total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
            total[: len(c)] += c
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])
    return run


BLOCKS = f"shard int, block long, first long, n int, data binary, pieces {PIECE}"


def _coded(table_bytes: bytes, kind: np.dtype):
    def run(batches):
        table, shard = rans.Table.frombytes(table_bytes), TaskContext.get().partitionId()
        base, held, ids, docs = 0, 0, [], []  # pending ids begin at the block that starts at base

        def flush(last: bool):
            nonlocal base, held, ids, docs
            flat = np.concatenate(ids) if ids else np.empty(0, kind)
            stop = len(flat) if last else len(flat) // BLOCK * BLOCK
            start, size = (np.array([d[k] for d in docs], np.int64) for k in (1, 2))
            lo, hi = np.maximum(start, base), np.minimum(start + size, base + stop)
            on = np.flatnonzero(hi > lo)
            spans = (hi[on] - 1) // BLOCK - lo[on] // BLOCK + 1
            doc = np.repeat(on, spans)
            block = lo[doc] // BLOCK + np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
            a, b = np.maximum(lo[doc], block * BLOCK), np.minimum(hi[doc], (block + 1) * BLOCK)
            order = np.argsort(block, kind="stable")
            names = pa.array([d[0] for d in docs], pa.int64())
            edge = np.searchsorted(block[order], np.arange(base // BLOCK, base // BLOCK + -(-stop // BLOCK) + 1))
            whole = pa.StructArray.from_arrays(
                [names.take(pa.array(doc[order])), pa.array(start[doc][order]), pa.array(size[doc][order]), pa.array((a - start[doc])[order].astype(np.int32)), pa.array((b - a)[order].astype(np.int32))],
                ["doc_id", "start", "total", "at", "length"])
            for at in range(0, stop, BLOCK * TOGETHER):
                own = [flat[x : min(x + BLOCK, stop)] for x in range(at, min(at + BLOCK * TOGETHER, stop), BLOCK)]
                number = base // BLOCK + at // BLOCK
                e = edge[at // BLOCK : at // BLOCK + len(own) + 1]
                lists = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), whole.slice(int(e[0]), int(e[-1] - e[0])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), shard, np.int32)), pa.array(np.arange(number, number + len(own))), pa.array(np.arange(number, number + len(own)) * BLOCK),
                     pa.array([len(x) for x in own], pa.int32()), pa.array(rans.encode(own, table), pa.binary()), lists], ["shard", "block", "first", "n", "data", "pieces"])
            ids, held = [flat[stop:].copy()], len(flat) - stop
            docs = [d for d in docs if d[1] + d[2] > base + stop]
            base += stop

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                x = np.frombuffer(x.as_buffer(), kind)
                ids.append(x)
                docs.append((doc_id, base + held, len(x)))
                held += len(x)
                if held >= BLOCK * TOGETHER:
                    yield from flush(False)
        yield from flush(True)
        release()
    return run


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of docs, each with end_id behind it, in ascending order of id to the folder path.

    Null and empty texts are an end id alone. Null ids come first; rows that repeat an id are documents of their own, in
    the order of their texts' hashes. Columns other than the two aren't read, whatever their names. No rows: a folder
    without blocks. What the driver holds is the frequency table, as many numbers as the tokenizer has ids.
    """
    spark = tuned(docs.sparkSession)
    kind = Encoder(tokenizer_path).kind
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    held = f"{scratch(spark, 'tokens')}/ids"
    rows.mapInArrow(_tokens(tokenizer_path, end_id), "doc_id long, tie long, ids binary").write.option("compression", "zstd").parquet(held)
    rows = spark.read.parquet(held)
    counts = {r["id"]: r["n"] for r in rows.select("ids").mapInArrow(_counts(kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    total = np.zeros(max(counts, default=-1) + 1, np.int64)
    total[list(counts)] = list(counts.values())
    table = rans.Table.of(total).tobytes()
    spark.createDataFrame([(bytearray(table),)], "raw binary").coalesce(1).write.parquet(f"{path}/table")
    shards = max(1, min(MAX_SHARDS, -(-int(total.sum()) // shard_ids)))
    # the third key parts rows that repeat id and text, which one shard needn't hold
    placed = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(shards, F.asc_nulls_first("doc_id"), "tie", "nth").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "nth")
    placed.select("doc_id", "ids").mapInArrow(_coded(table, kind), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _table(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/table").first()["raw"])


def _pieces(table_bytes: bytes):
    """Rows (doc_id, shard, start, total, at, ids) of the pieces in blocks."""
    def run(batches):
        table = rans.Table.frombytes(table_bytes)
        for batch in batches:
            for part in (batch.slice(lo, TOGETHER) for lo in range(0, batch.num_rows, TOGETHER)):
                decoded = rans.decode([x.as_py() for x in part.column("data")], table)
                for row, ids in enumerate(decoded):
                    pieces = part.column("pieces")[row].values
                    size = pieces.field("length").to_numpy()
                    edge = np.concatenate(([0], np.cumsum(size) * 4)).astype(np.int32)
                    raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                    shard = pa.array(np.full(len(size), part.column("shard")[row].as_py(), np.int32))
                    yield pa.RecordBatch.from_arrays([pieces.field("doc_id"), shard, pieces.field("start"), pieces.field("total"), pieces.field("at"), raw], ["doc_id", "shard", "start", "total", "at", "ids"])
    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, total, at, ids): the pieces of all documents, ids as little-endian unsigned 32-bit numbers.

    start is the document's place in its shard, at the piece's within the document. Documents that lie in one block are one
    piece. A block that is damaged, cut off or of another table raises an error.
    """
    tuned(spark)
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_pieces(_table(spark, path)), "doc_id long, shard int, start long, total long, at int, ids binary")


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32; the highest bit is the constant term."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


_POWERS = [0x00800000]  # x^8, x^16, x^32 ...


def crc_ahead(crc: int, length: int) -> int:
    """What a crc32 adds to that of a text in which length more bytes follow. The parts of a text are added by xor."""
    k = 0
    while length:
        if k == len(_POWERS):
            _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))
        if length & 1:
            crc = _times(_POWERS[k], crc)
        length, k = length >> 1, k + 1
    return crc


def _checksums(table_bytes: bytes):
    def run(batches):
        for batch in _pieces(table_bytes)(batches):
            size = np.diff(np.frombuffer(batch.column("ids").buffers()[1], np.int32)) // 4
            rest = batch.column("total").to_numpy() - batch.column("at").to_numpy() - size
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            for i in np.flatnonzero(rest).tolist():
                crc[i] = crc_ahead(crc[i], 4 * int(rest[i]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "shard", "start")), pa.array(size.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "start", "length", "crc"])
        release()
    return run


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: start counts the ids of all documents before it.

    Pieces are checked where they are decoded; a document's checksum is the xor of its pieces', each carried over the bytes
    behind it, so no document's ids come together.
    """
    tuned(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("ids"))  # as many rows as there are shards
    before = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    parts = blocks.mapInArrow(_checksums(_table(spark, path)), "doc_id long, shard int, start long, length long, crc long")
    docs = parts.groupBy("shard", "start").agg(F.first("doc_id").alias("doc_id"), F.sum("length").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return docs.join(small(cut(before), width=24), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op12(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = scratch(docs.sparkSession, "token-files")
    write(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return digest(docs.sparkSession, path)
