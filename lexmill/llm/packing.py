"""Lexical retrieval packing: whole token windows filled with lexically related documents.

Documents are tokenised where they are read and kept in the shared folder with the leaf that each belongs to: a tree,
built on a sample of the texts, halves the documents' projected BM25 vectors along their widest direction, so each leaf
is a shard of related documents wherever they were read. What a shard holds and its order follow from the documents
alone, not from files or partitions. Document frequencies and the mean length that scores are made of are those of all
documents. A shard holds a BM25 inverted index of its documents. A seed document opens a window; if it leaves room, the
index returns its best unused neighbours, which fill the window in order of score. The piece that doesn't fit opens the
next window, so every window of a shard is full but the last, and that one is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

import base64
import os
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch, tuned

WINDOW = 2048
END_ID = 1
#: Tokens a shard is planned for (4 MB of ids), what each document weighs besides its tokens, and how far a leaf may
#: outgrow the plan before it is parted.
SHARD_TOKENS = 2_000_000
DOC_WEIGHT = 64
SLACK = 1.5
#: Width of the vectors that documents are routed by; sampled documents a leaf, and in all.
DIMS = 64
LEAF_SAMPLE, SAMPLE = 64, 200_000
#: Terms that more than this share of a shard's documents hold keep their weights as a row over all of these.
DENSE = 0.1
K1, B = 1.2, 0.75
SPECIAL = "<|endoftext|>"


class ByteBpe:
    """Ids of the byte-level BPE vocabulary, equal to those of its tokenizers file.

    Where the same vocabulary lies beside it as ranks (a file of that name that ends in .tiktoken), these encode several
    times as fast; only texts that name the special token, which the tokenizers file reads as one id, take the slower way.
    """

    def __init__(self, json_path: str):
        self.path, self.slow, self.fast = json_path, None, None
        ranks_path = json_path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is None or SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def vocabulary(json_path: str) -> int:
    """One more than the greatest id of a tokenizers file, and of the end id."""
    from tokenizers import Tokenizer

    return max(END_ID, *Tokenizer.from_file(json_path).get_vocab().values()) + 1


def id_type(size: int) -> str:
    """The narrowest type for the ids of a vocabulary."""
    return "<u2" if size <= 1 << 16 else "<u4"


@dataclass
class Stats:
    """Number of documents, mean length and document frequencies (by token id) of a corpus."""

    n: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], size: int = 1 << 16) -> Stats:
        df = np.zeros(size, np.int64)
        for d in docs:
            df[np.unique(d)] += 1
        return cls(len(docs), sum(map(len, docs)) / max(len(docs), 1), df)

    @property
    def idf(self) -> np.ndarray:
        return np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5))


def weights(tf: np.ndarray, idf: np.ndarray, length: np.ndarray | int, mean: float) -> np.ndarray:
    """BM25 of one query term in documents."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1)))


def distinct(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, start): the distinct ids of each document in order, those of the d-th from start[d] to start[d + 1]."""
    size = np.array([len(d) for d in docs], np.int64)
    key = np.repeat(np.arange(len(docs), dtype=np.int64) << 32, size)
    if len(key):
        key |= np.concatenate(docs)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    start = np.searchsorted(key[first], np.arange(len(docs) + 1, dtype=np.int64) << 32)
    return key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key))), start


class Bm25:
    """Inverted index of a shard's documents; terms are token ids, statistics those of the corpus."""

    def __init__(self, docs: list[np.ndarray], stats: Stats | None = None):
        n = self.n = len(docs)
        stats = stats or Stats.of(docs)
        size = len(stats.df)
        self.terms, tf, self.first = distinct(docs)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))
        order = np.argsort(self.terms.astype(np.uint32), kind="stable")
        self.doc, term, tf = doc[order], self.terms[order], tf[order].astype(np.float64)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=size)))).astype(np.int64)
        length = np.array([len(d) for d in docs], np.float64)
        self.weight = weights(tf, stats.idf[term], length[self.doc], stats.mean)
        # frequent terms as rows over all documents, so that those of a seed are one product
        often = np.flatnonzero(np.diff(self.start) > DENSE * n)
        self.row = np.full(size, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n))
        for r, t in enumerate(often.tolist()):
            at = slice(self.start[t], self.start[t + 1])
            self.dense[r, self.doc[at]] = self.weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document against all distinct terms of the seed."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        row = self.row[terms]
        asked = np.zeros(len(self.dense))
        asked[row[row >= 0]] = 1
        rare = terms[row < 0]
        at = [slice(a, b) for a, b in zip(self.start[rare].tolist(), self.start[rare + 1].tolist(), strict=True)]
        if not at:
            return asked @ self.dense
        return asked @ self.dense + np.bincount(np.concatenate([self.doc[x] for x in at]), np.concatenate([self.weight[x] for x in at]), self.n)


class Router:
    """A tree over projected BM25 vectors; its leaves are numbered from 0."""

    def __init__(self, stats: Stats):
        self.idf, self.mean, self.signs = stats.idf, stats.mean, None
        self.axes, self.cuts, self.next = np.empty((0, DIMS), np.float32), np.empty(0, np.float32), np.empty((0, 2), np.int32)
        self.root = -1  # a leaf's number n is held as -1 - n

    def __getstate__(self):
        return self.__dict__ | {"signs": None}  # made anew by each worker

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        """Unit vectors of documents."""
        return self._vectors(*distinct(docs), np.array([len(d) for d in docs]))

    def _vectors(self, terms, tf, start, length) -> np.ndarray:
        if self.signs is None:
            self.signs = np.random.default_rng(0).integers(0, 2, (len(self.idf), DIMS), np.int8).astype(np.float32) * 2 - 1
        out, own = np.zeros((len(length), DIMS), np.float32), np.repeat(length, np.diff(start))
        weight = weights(tf, self.idf[terms], own, self.mean).astype(np.float32)
        for d, (lo, hi) in enumerate(pairwise(start.tolist())):
            out[d] = weight[lo:hi] @ self.signs[terms[lo:hi]]
        return out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-9)[:, None]

    def grow(self, x: np.ndarray, weight: np.ndarray, limit: float) -> Router:
        """Halves the sample's weight until no part weighs more than limit, or all of a part's vectors are equal."""
        axes, cuts, following, leaves = [], [], [], 0

        def node(rows: np.ndarray) -> int:
            nonlocal leaves
            if weight[rows].sum() > limit:
                own = x[rows].astype(np.float64)
                axis = np.linalg.eigh(np.cov(own.T, aweights=weight[rows], ddof=0))[1][:, -1].astype(np.float32)
                at = x[rows] @ axis
                order = np.argsort(at, kind="stable")
                total = np.cumsum(weight[rows][order])
                cut = at[order][np.searchsorted(total, total[-1] / 2)]
                low = at < cut
                if not low.any():
                    cut = at[at > cut].min() if (at > cut).any() else cut
                    low = at < cut
                if low.any():
                    me = len(axes)
                    axes.append(axis)
                    cuts.append(cut)
                    following.append([0, 0])
                    following[me] = [node(rows[low]), node(rows[~low])]
                    return me
            leaves += 1
            return -leaves

        self.root = node(np.arange(len(x)))
        self.axes, self.cuts, self.next = np.array(axes, np.float32).reshape(-1, DIMS), np.array(cuts, np.float32), np.array(following, np.int32).reshape(-1, 2)
        return self

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.full(len(x), int(self.root))
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            right = np.einsum("ij,ij->i", x[live], self.axes[node]) >= self.cuts[node]
            at[live] = self.next[node, right.astype(int)]
            live = live[at[live] >= 0]
        return -1 - at


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, stats: Stats | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard. Each token lies in exactly one piece.

    Documents are seeds in their order; ties of scores (to nine places) go to the earlier document.
    """
    index = Bm25(docs, stats)
    unused = np.ones(len(docs), bool)
    out, seq, room, cursor = [], 0, window, 0
    opener, queue = None, []

    def put(d: int):
        nonlocal seq, room, opener, queue
        unused[d] = False
        start, left = 0, len(docs[d])
        while left:
            take = min(left, room)
            if room == window:
                opener, queue = d, None
            out.append((d, start, take, seq, window - room))
            start, left, room = start + take, left - take, room - take
            if not room:
                seq, room = seq + 1, window

    while True:
        while cursor < len(docs) and not unused[cursor]:
            cursor += 1
        if cursor == len(docs):
            break
        if room == window:
            put(cursor)
            continue
        if queue is None:  # the opener's neighbours, best first; enough of them to fill the window
            score = np.where(unused, np.round(index.scores(opener), 9), -1.0)
            few = min(len(docs), 64)
            best = np.argpartition(-score, few - 1)[:few]
            queue = best[np.lexsort((best, -score[best]))].tolist()[::-1]
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            put(queue.pop())
        else:
            queue = None
    if room < window:  # the last window: powers of two, largest first
        full, tail = [p for p in out if p[3] < seq], [p for p in out if p[3] == seq]
        left = window - room
        size = 1 << (left.bit_length() - 1)
        left -= size
        used = 0
        for d, start, length, _, _ in tail:
            while length:
                take = min(length, size - used)
                full.append((d, start, take, seq, used))
                start, length, used = start + take, length - take, used + take
                if used == size and left:
                    size = 1 << (left.bit_length() - 1)
                    left, used, seq = left - size, 0, seq + 1
                elif used == size:
                    used = 0
        out = full
    return out


def _sampled(path: str, kind: str):
    """(h, docs, n, ids) of sampled texts."""
    def run(batches):
        encode = ByteBpe(path)
        for batch in batches:
            ids = [np.append(encode(t.as_py()), np.uint32(END_ID)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(d) for d in ids], pa.int64()), pa.array([d.astype(kind).tobytes() for d in ids], pa.binary())], ["h", "docs", "n", "ids"])
        release()
    return run


def _tokens(path: str, kind: str, router: Router):
    """(doc_id, n, leaf, ids) of each document, and at last a row of leaf -1 with the task's document frequencies."""
    def run(batches):
        encode, df = ByteBpe(path), np.zeros(len(router.idf), "<u8")
        names = ["doc_id", "n", "leaf", "ids"]
        for batch in batches:
            docs = [np.append(encode(t.as_py()), np.uint32(END_ID)) for t in batch.column(1)]
            if not docs:
                continue
            n, (terms, tf, start) = np.array([len(d) for d in docs], np.int64), distinct(docs)
            df += np.bincount(terms, minlength=len(df)).astype(df.dtype)
            leaf = router.leaves(router._vectors(terms, tf, start, n)) if router.root >= 0 else np.full(len(n), -1 - router.root)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(leaf, pa.int64()), pa.array([d.astype(kind).tobytes() for d in docs], pa.binary())], names)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(terms)], pa.int64()), pa.array([-1], pa.int64()), pa.array([terms.astype("<u4").tobytes() + df[terms].tobytes()], pa.binary())], names)
        release()
    return run


def _ids(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _frequencies(batches):
    """(term, df) from the rows that tasks have left: terms, then their frequencies."""
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<u4", n).astype(np.int64)), pa.array(np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64))], ["term", "df"])


def _sample_frequencies(kind: str):
    def run(batches):
        df: dict[int, int] = {}
        for batch in batches:
            for d in _ids(batch.column(0), kind):
                for t in np.unique(d).tolist():
                    df[t] = df.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["term", "df"])
    return run


def _vectors(router: Router, kind: str):
    def run(batches):
        for batch in batches:
            x = [v.astype("<f4").tobytes() for v in router.vectors(_ids(batch.column(3), kind))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x, pa.binary())], ["h", "docs", "n", "x"])
    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(stats: Stats, window: int, limit: float, kind: str, with_ids: bool):
    schema = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids

    def run(batches):
        shard, seq, ids, docs, total = None, 0, [], [], 0

        def flush():
            nonlocal seq, ids, docs, total
            pieces = pack_shard(docs, window, stats)
            base = (shard[0] << 44) + (shard[1] << 28) + seq
            for lo in range(0, len(pieces), 2000):
                part = pieces[lo : lo + 2000]
                cut = [docs[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in part]
                longs = [[ids[p[0]] for p in part], [p[1] for p in part], [p[2] for p in part], list(map(zlib.crc32, cut)), [len(docs[p[0]]) for p in part], [base + p[3] for p in part], [p[4] for p in part]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), *([pa.array(cut, pa.binary())] if with_ids else [])], schema)
            seq, ids, docs, total = seq + pieces[-1][3] + 1, [], [], 0

        for batch in batches:
            for i, leaf, part, d in zip(*(batch.column(k).to_pylist() for k in range(3)), _ids(batch.column(3), kind), strict=True):
                if docs and (shard != (leaf, part) or total + len(d) + DOC_WEIGHT > limit):
                    yield from flush()
                if shard != (leaf, part):
                    shard, seq = (leaf, part), 0
                ids.append(i)
                docs.append(d)
                total += len(d) + DOC_WEIGHT
        if docs:
            yield from flush()
        release()
    return run


def _router(docs: DataFrame, path: str, size: int, root: str, shard_tokens: int) -> Router:
    """A tree over a bounded sample by content, equal texts taken together. docs: doc_id, text."""
    kind, spark = id_type(size), docs.sparkSession
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    whole = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    nothing = Stats(0, 1.0, np.zeros(size, np.int64))
    if whole["bytes"] + (DOC_WEIGHT + 1) * whole["docs"] <= shard_tokens:  # a token has a byte at least
        return Router(nothing)
    share = min(LEAF_SAMPLE * whole["bytes"] / (3 * shard_tokens), SAMPLE) / whole["docs"]
    h = F.xxhash64("text")
    drawn = docs.where(F.pmod(h, F.lit(1 << 20)) < F.lit(max(int(share * (1 << 20)), 1))).groupBy(h.alias("h")).agg(F.count("*").alias("docs"), F.first("text").alias("text"))
    drawn.mapInArrow(_sampled(path, kind), "h long, docs long, n long, ids binary").write.parquet(f"{root}/sample")
    sample = spark.read.parquet(f"{root}/sample")
    held = sample.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum(F.col("docs") * (F.col("n") + DOC_WEIGHT)).alias("weight")).first()
    if not held["docs"]:
        return Router(nothing)
    df = np.zeros(size, np.int64)
    for r in sample.select("ids").mapInArrow(_sample_frequencies(kind), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a token id
        df[r["term"]] = r["df"]
    router = Router(Stats(held["docs"], held["tokens"] / held["docs"], df))
    rows = sorted(sample.mapInArrow(_vectors(router, kind), "h long, docs long, n long, x binary").collect())  # at most about SAMPLE
    weight = np.array([r["docs"] * (r["n"] + DOC_WEIGHT) for r in rows], np.float64)
    # the sample stands for about so many tokens in all
    return router.grow(np.array([np.frombuffer(r["x"], "<f4") for r in rows]).reshape(-1, DIMS), weight / max(share, 1e-12), shard_tokens)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and if asked ids: little-endian 32-bit).

    A document is its ids and then the end id; null texts are empty, so they are one end id. Sequences hold window
    tokens, or a power of two of them at a shard's end. Repeated rows are packed once each, ids may be null, other
    columns aren't read, and an empty table gives no rows. Which pieces share a sequence, and sequence_id, depend on the
    documents only, not on how they are parted into files. Tokens are written to the shared folder when this is called.
    """
    spark = tuned(docs.sparkSession)
    root, size = scratch(spark, "packing"), vocabulary(tokenizer_path)
    kind = id_type(size)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    router = _router(docs, tokenizer_path, size, root, shard_tokens)
    docs.mapInArrow(_tokens(tokenizer_path, kind, router), "doc_id long, n long, leaf long, ids binary").write.option("compression", "zstd").parquet(f"{root}/tokens")
    tokens = spark.read.parquet(f"{root}/tokens")
    routed = tokens.where("leaf >= 0")
    whole = routed.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    df = np.zeros(size, np.int64)
    for r in tokens.where("leaf < 0").select("n", "ids").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a token id
        df[r["term"]] = r["df"]
    stats, limit = Stats(whole["docs"], whole["tokens"] / max(whole["docs"], 1), df), SLACK * shard_tokens
    parts = routed.groupBy("leaf").agg(F.ceil(F.sum(F.col("n") + DOC_WEIGHT) / limit).alias("parts"))  # a row a leaf
    shard = routed.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("ids", "doc_id"), F.col("parts")))
    return shard.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.xxhash64("ids"), "doc_id").select("doc_id", "leaf", "part", "ids").mapInArrow(
        _pack(stats, window, limit, kind, with_ids), PIECE + ", ids binary" * with_ids)


def op8(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
