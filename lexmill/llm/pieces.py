"""SentencePiece encoding and decoding, in batches of words.

Texts are parted into words at the space marker, which no piece crosses. New words of a batch are grouped by length, and
words of equal length advance together: rolling hashes give every substring of up to the longest piece's length, which
probe the sorted keys of that length's pieces, and vectorised maxima keep the best score and its piece's length at each
position. Characters without a piece are written as bytes. The path found is the one of greatest total piece score, the
longer last piece where scores tie.

A model trained by BPE encodes otherwise: of all neighbouring symbols that form a piece, those of the best piece merge
first, the leftmost where scores tie. Merges does that for words of equal length at once, and its ids are the model's.
Encoder takes the best path wherever it is what the merges give, which neighbouring pieces tell: a split is that of the
merges if and only if that holds of each two neighbours by themselves. Only the other words are merged.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned

MARK = "▁"
#: Stands for a literal marker inside a text, which has no piece and so becomes bytes. No text in UTF-8 holds it.
LITERAL = "\ud800"
#: Words whose ids a worker keeps, and substrings that are probed at once.
CACHE, CELLS = 800_000, 200_000
#: What an unknown character scores below the least piece.
PENALTY = 10.0
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(f"{MARK}*[^{MARK}]*")


class Pieces:
    """The pieces of a model file, as sorted hash keys for each length."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.plain = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        crossing = [p for p in self.plain if MARK in p.lstrip(MARK)]
        if crossing or len(self.bytes) != 256:
            raise ValueError("pieces that cross words, or no byte pieces")
        self.unknown = min(s for _, s in self.plain.values()) - PENALTY
        self.table = [b""] * len(ids)
        for b, i in self.bytes.items():
            self.table[i] = bytes([b])
        by: dict[int, list] = {}
        for p, (i, s) in self.plain.items():
            self.table[i] = p.replace(MARK, " ").encode()
            by.setdefault(len(p), []).append((int((_hash(np.array([list(map(ord, p))], np.uint64)) * _SPREAD)[0]), i, s))
        self.by = {}
        for n, rows in by.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            first = np.searchsorted(keys, np.arange(65537, dtype=np.float64) * 2.0**48).astype(np.int32)
            spelt = np.array([list(map(ord, model.id_to_piece(r[1]))) for r in rows], np.uint32)
            self.by[n] = (keys, first, np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows]), spelt)
        self.longest, self.spell = max(self.by), {i: len(p) for p, (i, _) in self.plain.items()}
        self.known: dict[str, bytes] = {}

    def _solve(self, words: list[str]) -> list[bytes]:
        """Ids (16-bit, or 32-bit in a larger model) of words of one length."""
        return self._packed(words, self._paths(words))

    def _paths(self, words: list[str]) -> np.ndarray:
        """The pieces of the best paths of words of one length, a row a word: -2 before them, -1 for characters without a piece."""
        m, n = len(words), len(words[0])
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        prefix = np.zeros((m, n + 1), np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _BASE + c[:, j]
        lengths = [k for k in range(min(n, self.longest), 0, -1) if k in self.by or k == 1]
        score, piece = {}, {}
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(lengths[0], _BASE))))
        for k in lengths:
            h = (prefix[:, k:] - prefix[:, : n + 1 - k] * powers[k]) * _SPREAD
            score[k] = np.full(h.shape, self.unknown if k == 1 else -np.inf)
            piece[k] = np.full(h.shape, -1, np.int32)
            if k in self.by:
                windows = np.lib.stride_tricks.sliding_window_view(c, k, axis=1)
                width = windows.shape[1]
                self._probe(k, h.ravel(), score[k].ravel(), piece[k].ravel(), lambda i, w=windows, n=width: w[i // n, i % n])
        best, back = np.full((m, n + 1), -np.inf), np.zeros((m, n + 1), np.int32)
        best[:, 0] = 0
        for j in range(1, n + 1):
            top, step = best[:, j], back[:, j]
            for k in lengths:
                if k <= j:
                    cand = best[:, j - k] + score[k][:, j - k]
                    better = cand > top
                    np.copyto(top, cand, where=better)
                    step[better] = k
        out = np.full((m, n), -2, np.int32)
        pos, row, depth = np.full(m, n), np.arange(m), 0
        while len(row):
            k = back[row, pos]
            pos = pos - k
            for kk in np.unique(k).tolist():
                own = k == kk
                out[row[own], n - 1 - depth] = piece[kk][row[own], pos[own]]
            row, pos, depth = row[pos > 0], pos[pos > 0], depth + 1
        return out

    def _packed(self, words: list[str], out: np.ndarray) -> list[bytes]:
        real = out != -2
        kind = np.uint16 if len(self.table) <= 65536 else np.uint32
        width = np.dtype(kind).itemsize
        flat = out[real].astype(kind).tobytes()
        edge = np.concatenate(([0], np.cumsum(real.sum(axis=1) * width))).tolist()
        result = [flat[x:y] for x, y in zip(edge, edge[1:], strict=False)]
        for r in np.flatnonzero((out == -1).any(axis=1)).tolist():
            result[r] = self._bytes(words[r], out[r][real[r]]).astype(kind).tobytes()
        return result

    def _probe(self, k: int, h: np.ndarray, score: np.ndarray, piece: np.ndarray, letters) -> None:
        """Fills in score and piece where h is among the sorted keys; its top 16 bits say where those keys begin.

        Where a key is found, the substring's letters are compared with the piece's.
        """
        keys, first, ids, scores, spelt = self.by[k]
        top = (h >> np.uint64(48)).astype(np.int32)
        at, end = first[top], first[top + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = np.flatnonzero(keys[at] == h[left])
            hit = hit[(letters(left[hit]) == spelt[at[hit]]).all(axis=1)]
            score[left[hit]], piece[left[hit]] = scores[at[hit]], ids[at[hit]]
            more = at + 1 < end
            more[hit] = False
            left, at, end = left[more], at[more] + 1, end[more]

    def _bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
                at += self.spell[i]
            else:
                out += [self.bytes[b] for b in (MARK if word[at] == LITERAL else word[at]).encode("utf-8", "surrogatepass")]
                at += 1
        return np.array(out, np.int32)

    def learn(self, words: set[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, group in by.items():
            step = max(1, CELLS // (n + 1))
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                self.known.update(zip(part, self._solve([MARK + w for w in part]), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        kind = np.uint16 if len(self.table) <= 65536 else np.uint32
        if len(self.known) > CACHE:
            self.known.clear()
        parted = self._parted(texts)
        self.learn({w for w in set().union(*parted) if w not in self.known})
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in words]), kind) for words in parted]

    @staticmethod
    def _parted(texts: list[str | None]) -> list[list[str]]:
        """Words less their first marker."""
        parted = []
        for t in texts:
            if not t:
                parted.append([])
                continue
            words = (t.replace(MARK, LITERAL) if MARK in t else t).split(" ")
            parted.append(words if "" not in words else [w[1:] for w in _WORD.findall(MARK + MARK.join(words)) if w])
        return parted

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


class Merges(Pieces):
    """The ids of a BPE model: the order of its merges instead of the best path."""

    def _solve(self, words: list[str]) -> list[bytes]:
        m, n = len(words), len(words[0])
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        prefix = np.zeros((m, n + 1), np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _BASE + c[:, j]
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))))

        def probe(row, lo, hi):
            """Score and piece of each substring lo to hi of the row."""
            score, piece = np.full(len(row), -np.inf), np.full(len(row), -1, np.int32)
            for k in np.unique(hi - lo).tolist():
                if k in self.by:
                    at = np.flatnonzero(hi - lo == k)
                    h = (prefix[row[at], hi[at]] - prefix[row[at], lo[at]] * powers[k]) * _SPREAD
                    s, p = score[at], piece[at]
                    self._probe(k, h, s, p, lambda i, r=row[at], x=lo[at], k=k: c[r[i][:, None], x[i][:, None] + np.arange(k)])
                    score[at], piece[at] = s, p
            return score, piece

        # A symbol is known by its first position; after[x] is the next one's, before[x] the last one's
        after = np.tile(np.arange(1, n + 1), (m, 1))
        before = np.tile(np.arange(-1, n - 1), (m, 1))
        grid = np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
        piece = probe(*grid, grid[1] + 1)[1].reshape(m, n)
        gain, merged = np.full((m, n), -np.inf), np.full((m, n), -1, np.int32)  # of a symbol with the next
        if n > 1:
            row, lo = np.repeat(np.arange(m), n - 1), np.tile(np.arange(n - 1), m)
            gain[row, lo], merged[row, lo] = probe(row, lo, lo + 2)
        live = np.ones((m, n), bool)
        row = np.arange(m)
        while len(row):
            left = gain[row].argmax(axis=1)
            on = gain[row, left] > -np.inf
            row, left = row[on], left[on]
            if not len(row):
                break
            right = after[row, left]
            end = after[row, right]
            piece[row, left], after[row, left], live[row, right] = merged[row, left], end, False
            gain[row, left] = gain[row, right] = -np.inf
            more = end < n
            before[row[more], end[more]] = left[more]
            r, x = row[more], left[more]
            gain[r, x], merged[r, x] = probe(r, x, after[r, end[more]])
            prior = before[row, left]
            more = prior >= 0
            r, x = row[more], prior[more]
            gain[r, x], merged[r, x] = probe(r, x, end[more])
        kind = np.uint16 if len(self.table) <= 65536 else np.uint32
        width = np.dtype(kind).itemsize
        flat = piece[live].astype(kind).tobytes()
        edge = np.concatenate(([0], np.cumsum(live.sum(axis=1) * width))).tolist()
        result = [flat[x:y] for x, y in zip(edge, edge[1:], strict=False)]
        for r in np.flatnonzero((live & (piece == -1)).any(axis=1)).tolist():
            result[r] = self._bytes(words[r], piece[r][live[r]]).astype(kind).tobytes()
        return result


class Encoder(Merges):
    """The ids of a BPE model: the best path of a word if the merges give the same, else its merges.

    What two neighbours give by themselves is found once a pair, by merging their letters; a single piece counts too.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.spelt = {i: p for p, (i, _) in self.plain.items()}
        self.pairs: dict[int, bool] = {}
        self.merged: set[str] = set()

    def _learn_pairs(self, keys: list[int]) -> None:
        size = len(self.table) + 1  # the second is 0 for a piece alone, else one more than its id
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        by: dict[int, list] = {}
        for key in keys:
            ids = [key // size] + ([key % size - 1] if key % size else [])
            text = "".join(self.spelt[i] for i in ids)
            by.setdefault(len(text), []).append((key, ids, text))
        kind = np.uint16 if len(self.table) <= 65536 else np.uint32
        for n, group in by.items():
            step = max(1, CELLS // (n + 1))
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                got = Merges._solve(self, [text for _, _, text in part])
                self.pairs.update((key, np.array(ids, kind).tobytes() == x) for (key, ids, _), x in zip(part, got, strict=True))

    def stable(self, out: np.ndarray) -> np.ndarray:
        """Which of the best paths are what the merges give."""
        size = len(self.table) + 1
        a, b = out[:, :-1], out[:, 1:]
        single = out[:, -1:].astype(np.int64) * size
        keys = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * size + b + 1, -1) if out.shape[1] > 1 else np.full((len(out), 0), -1, np.int64)
        alone = (out >= 0).sum(axis=1) == 1
        keys = np.concatenate((keys, np.where(alone[:, None], single, -1)), axis=1)
        known = (out != -1).all(axis=1)
        keys[~known] = -1
        uniq, inv = np.unique(keys, return_inverse=True)
        self._learn_pairs([k for k in uniq.tolist() if k >= 0 and k not in self.pairs])
        fine = np.array([k < 0 or self.pairs[k] for k in uniq.tolist()], bool)
        return known & fine[inv.reshape(keys.shape)].all(axis=1)

    def _solve(self, words: list[str]) -> list[bytes]:
        out = self._paths(words)
        ok = self.stable(out)
        on, off = np.flatnonzero(ok).tolist(), np.flatnonzero(~ok).tolist()
        result: list[bytes] = [b""] * len(words)
        for i, x in zip(on, self._packed([words[i] for i in on], out[ok]) if on else [], strict=True):
            result[i] = x
        for i, x in zip(off, super()._solve([words[i] for i in off]) if off else [], strict=True):
            result[i] = x
            self.merged.add(words[i][1:])
        return result

    def digest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, edges, words of each text, those of them on their best path)."""
        if len(self.known) > CACHE:
            self.known.clear()
            self.merged.clear()
        kind = np.uint16 if len(self.table) <= 65536 else np.uint32
        parted = self._parted(texts)
        self.learn({w for w in set().union(*parted) if w not in self.known})
        raw = [b"".join(map(self.known.__getitem__, words)) for words in parted]
        edge = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64))) // np.dtype(kind).itemsize
        n = np.array([len(words) for words in parted], np.int64)
        merged = np.array([sum(map(self.merged.__contains__, words)) for words in parted], np.int64)
        return np.frombuffer(b"".join(raw), kind), edge, n, n - merged


def _hash(c: np.ndarray) -> np.ndarray:
    h = np.zeros(len(c), np.uint64)
    for j in range(c.shape[1]):
        h = h * _BASE + c[:, j]
    return h


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, which keeps its words (at most CACHE) from task to task."""
    return Encoder(path)


def _encode(path: str):
    def run(batches):
        pieces = _encoder(path)
        for batch in batches:
            flat, edge, _, _ = pieces.digest(batch.column(1).to_pylist())
            flat = flat.astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in pairwise(edge.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat.astype(np.int32))), pa.array(crc, pa.int64())], ["id", "ids", "crc"])
    return run


def _decode(path: str):
    def run(batches):
        pieces = Pieces(path)
        for batch in batches:
            lists = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if not x.is_valid else pieces.decode(x.values.to_numpy()) for x in lists], pa.string())], ["id", "text"])
    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids: array<int>, ids_crc32 of little-endian 32-bit ids), one row for each of docs, read where they lie.

    Null and empty texts have no ids. A literal marker character and others without a piece become byte pieces, so
    decode() gives every text back exactly. The ids are those of the model's own encoding, which for BPE is the order of
    merges; other texts than those with a literal marker are encoded alike. Ids may be null or repeat; other columns
    aren't read; no rows: no rows.
    """
    tuned(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode(model_path), "id long, ids array<int>, crc long").select(
        F.col("id").alias(id_col), "ids", F.col("crc").alias("ids_crc32"))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of arrays of ids; a null array gives null, an empty one an empty text."""
    tuned(encoded.sparkSession)
    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(model_path), "id long, text string").select(F.col("id").alias(id_col), "text")


def _digest(path: str):
    def run(batches):
        pieces = _encoder(path)
        low, high = min(pieces.bytes.values()), max(pieces.bytes.values())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            flat, edge, n_words, by_path = pieces.digest(texts)
            wide, spans = flat.astype("<u4"), list(pairwise(edge.tolist()))
            raw = np.concatenate(([0], np.cumsum((flat >= low) & (flat <= high))))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(edge)), pa.array(np.diff(raw[edge])), pa.array([zlib.crc32(wide[a:b]) for a, b in spans], pa.int64()),
                pa.array([pieces.decode(flat[a:b]) == (t or "") for (a, b), t in zip(spans, texts, strict=True)], pa.bool_()), pa.array(n_words), pa.array(by_path)],
                ["doc_id", "n_tokens", "n_byte_pieces", "ids_crc32", "round_trip", "n_words", "n_by_viterbi"])
    return run


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass: (doc_id, n_tokens, n_byte_pieces, ids_crc32, round_trip, n_words, n_by_viterbi).

    n_by_viterbi counts the words whose ids are those of their best path; the others were merged.
    """
    tuned(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _digest(model_path), "doc_id long, n_tokens long, n_byte_pieces long, ids_crc32 long, round_trip boolean, n_words long, n_by_viterbi long")


def op2(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digest(docs, public_tokenizers.path("piece_bpe_32k.model"))
