"""Language identification by a linear-chain conditional random field over words.

Each word has weights by hashed features: its affixes, its character n-grams and, for words of the training sample, its
lexicon entry. Learned transitions link neighbouring words, so that a word both languages share follows its neighbours
and a switch of language inside a text costs. Forward-backward gives every word's posterior; a document's language is
the one of most posterior mass, weighted by word length.

Training is on a bounded sample of labelled rows, collected by the driver: windows of documents of every language.
Prediction reads whole texts where they lie; chains too long to be held are walked in blocks, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, tuned

#: Bounds of the training sample: documents of one language, and the characters of the window drawn from each.
DOCS, CHARS = 300, 20_000
#: The characters of a whole sample, the most frequent labels that are learned, labels that a training step tells apart,
#: and weights: with more labels than these allow, windows and documents are fewer and hashed features share weights.
SAMPLE, LABELS, GROUP, WEIGHTS = 32_000_000, 4096, 32, 1 << 26
#: Hashed features, words of a training sequence, sequences of a step, the share of sequences that switch, and steps for
#: up to so many languages (for more, in proportion).
BITS, LENGTH, BATCH, SWITCH, STEPS, STEPS_FOR = 17, 24, 64, 0.3, 240, 16
#: Weights of words that a worker keeps, documents that advance together, and cells (words x languages) held at a time.
CACHE, TOGETHER, CELLS = 2_400_000, 256, 1_000_000
#: The share of a text that its leading language must hold in reject_unknown(): so many times the even share, at most LEAST.
LEAD, LEAST = 1.2, 0.3
NONE = "und"


@lru_cache(maxsize=2)
def _word(end: int) -> re.Pattern:
    """A letter, and then letters and combining marks, of the code points below end."""
    kinds: dict[bool, list[list[int]]] = {True: [], False: []}
    for c in range(end):
        if (letter := chr(c).isalpha()) or unicodedata.category(chr(c))[0] == "M":
            for into in (True, False) if letter else (False,):
                if kinds[into] and kinds[into][-1][1] == c - 1:
                    kinds[into][-1][1] = c
                else:
                    kinds[into].append([c, c])
    first, rest = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in (True, False))
    return re.compile(f"[{first}][{rest}]*")


_HIGH = re.compile("[\U00010000-\U0010ffff]")


def _pattern(text: str) -> re.Pattern:
    """The pattern of words, which is several times as fast below 2^16."""
    return _word(0x110000 if _HIGH.search(text) else 0x10000)


def words(text: str | None) -> list[str]:
    """Lower-cased words: runs of letters (as str.isalpha has them) and the combining marks among them."""
    return _pattern(text).findall(text.lower()) if text else []


def features(group: list[str], lexicon: dict[str, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, below 2^bits, and the word that each belongs to (ascending)."""
    marked = [f"^{w}$" for w in group]
    size = np.array([len(w) for w in marked])
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    word = np.repeat(np.arange(len(group)), size)
    left = np.repeat(end, size) - np.arange(len(c))  # characters from here to the word's end
    out, own = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 4):  # n-grams, the marks included: those at the ends are affixes
        nxt = np.zeros(len(c), np.uint64)
        nxt[: len(c) - n + 1] = c[n - 1 :]
        h = (h + nxt) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        if n > 1:
            ok = left >= n
            out.append(h[ok])
            own.append(word[ok])
    for k, at in ((5, start), (6, end - 4)):  # longer affixes: three letters and the mark
        ok = size >= 5
        i = at[ok]
        g = np.zeros(len(i), np.uint64)
        for d in range(4):
            g = (g + c[i + d]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)
        out.append(g)
        own.append(np.flatnonzero(ok))
    known = np.array([lexicon.get(w, -1) for w in group])
    out.append((known[known >= 0].astype(np.uint64) + np.uint64(77)) * np.uint64(0xA0761D6478BD642F))
    own.append(np.flatnonzero(known >= 0))
    f, own = np.concatenate(out), np.concatenate(own)
    f = ((f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
    order = np.argsort(own, kind="stable")
    return f[order].astype(np.int64), own[order]


class Crf:
    """Weights of features and transitions, with K languages in order."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, begin: np.ndarray, lexicon: dict[str, int]):
        self.langs, self.weights, self.trans, self.begin, self.lexicon = langs, weights, trans, begin, lexicon

    def emissions(self, group: list[str]) -> np.ndarray:
        f, own = features(group, self.lexicon, len(self.weights).bit_length() - 1)
        out = np.zeros((len(group), len(self.langs)))
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] = np.add.reduceat(self.weights[f].astype(np.float64), first, axis=0)
        return out

    def posteriors(self, psi: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Forward-backward. psi: T x B x K positive emissions, sizes descending; posteriors of the same shape."""
        steps, b, k = psi.shape
        t = np.exp(self.trans)
        alpha = np.empty_like(psi)
        live = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")  # documents with so many words
        a = np.exp(self.begin) * psi[0]
        alpha[0] = a / a.sum(axis=1, keepdims=True)
        for i in range(1, steps):
            n = live[i]
            a = (alpha[i - 1, :n] @ t) * psi[i, :n]
            alpha[i, :n] = a / a.sum(axis=1, keepdims=True)
        beta = np.ones((b, k))
        for i in range(steps - 2, -1, -1):
            n = live[i + 1]
            x = (psi[i + 1, :n] * beta[:n]) @ t.T
            beta[:n] = x / x.sum(axis=1, keepdims=True)
            p = alpha[i, :n] * beta[:n]
            alpha[i, :n] = p / p.sum(axis=1, keepdims=True)
        return alpha

    def blocks(self, psi, steps: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
        """(start, posteriors) of one document's blocks, from the last to the first; psi(a, b) gives emissions a to b."""
        t = np.exp(self.trans)

        def forward(x, a):
            out = np.empty_like(x)
            for i, e in enumerate(x):
                a = (np.exp(self.begin) if a is None else a @ t) * e
                out[i] = a = a / a.sum()
            return out

        starts, a = [], None
        for lo in range(0, steps, block):
            starts.append(a)
            a = forward(psi(lo, min(lo + block, steps)), a)[-1]
        beta = np.ones(len(self.langs))
        for n in reversed(range(len(starts))):
            x = psi(n * block, min((n + 1) * block, steps))
            post = forward(x, starts[n])
            for i in range(len(x) - 1, -1, -1):
                post[i] *= beta
                post[i] /= post[i].sum()
                beta = (x[i] * beta) @ t.T
                beta /= beta.sum()
            yield n * block, post


def expected_pairs(post: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Sums over steps and sequences of neighbours' joint posteriors (K x K), from single posteriors and transitions.

    Each step's joint posteriors are the transitions times an outer product, scaled to 1, so that all steps' are one
    product of matrices and no array holds steps x sequences x K x K.
    """
    k, e = post.shape[2], np.exp(trans)
    a, b = post[:-1].reshape(-1, k), post[1:].reshape(-1, k)
    scale = ((a @ e) * b).sum(axis=1, keepdims=True)
    return e * ((a / scale).T @ b)


def train(sample: list[tuple[str, str]], seed: int = 7) -> Crf | None:
    """Fits the field to (text, language) rows by AdaGrad. None if no row has a word.

    A document's language labels all its words; sequences spliced from two documents teach what a switch costs. Of more
    than GROUP languages a step draws so many, and fits the field of these alone, so a step's cost doesn't grow with K.
    """
    names: list[str] = []
    docs, index, counts = [], {}, {}
    for text, lang in sample:
        if found := words(text):
            for w in set(found):
                counts[w] = counts.get(w, 0) + 1
            docs.append(np.array([index.setdefault(w, len(index)) for w in found], np.int32))
            names.append(lang)
    langs = sorted(set(names))
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(seed)
    vocab = sorted(index)
    lexicon = {w: i for i, w in enumerate(w for w in vocab if counts[w] > 2)}
    place = np.empty(len(vocab), np.int32)
    place[[index[w] for w in vocab]] = np.arange(len(vocab))
    bits = min(BITS, (WEIGHTS // k).bit_length() - 1)
    f, own = features(vocab, lexicon, bits)
    edge = np.searchsorted(own, np.arange(len(vocab) + 1))
    at = {lang: i for i, lang in enumerate(langs)}
    by: list[list[np.ndarray]] = [[] for _ in langs]
    for lang, d in zip(names, docs, strict=True):
        by[at[lang]].append(place[d])
    del vocab, index, counts, docs, own
    crf = Crf(langs, np.zeros((1 << bits, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    g2, t2, b2 = np.full((1 << bits, k), 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
    size, few = np.full(BATCH, LENGTH), min(k, GROUP)

    def chunk(lang: int, n: int) -> np.ndarray:
        out = np.empty(0, np.int64)
        while len(out) < n:  # short documents follow one another
            d = by[lang][rng.integers(len(by[lang]))]
            s = rng.integers(max(1, len(d) - n + 1))
            out = np.concatenate((out, d[s : s + n - len(out)]))
        return out

    for _ in range(STEPS * max(1, -(-k // STEPS_FOR))):
        here = np.sort(rng.choice(k, few, replace=False)) if few < k else np.arange(k)
        part = Crf([], crf.weights, crf.trans[np.ix_(here, here)], crf.begin[here], lexicon)
        seqs, gold = np.empty((BATCH, LENGTH), np.int64), np.empty((BATCH, LENGTH), np.int64)
        for i in range(BATCH):
            a, n = rng.integers(few), LENGTH
            if few > 1 and rng.random() < SWITCH:
                n = int(rng.integers(LENGTH // 4, LENGTH - LENGTH // 4))
                b = rng.integers(few)
                seqs[i, n:], gold[i, n:] = chunk(here[b], LENGTH - n), b
            seqs[i, :n], gold[i, :n] = chunk(here[a], n), a
        w, back = np.unique(seqs, return_inverse=True)
        back = back.reshape(seqs.shape)
        feats = np.concatenate([f[edge[x] : edge[x + 1]] for x in w])
        count = edge[w + 1] - edge[w]
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        uniq, inv = np.unique(feats, return_inverse=True)
        rows = np.ix_(uniq, here)
        e = np.add.reduceat(crf.weights[rows].astype(np.float64)[inv], first, axis=0)
        psi = np.exp(e - e.max(axis=1, keepdims=True))[back].transpose(1, 0, 2)
        post = part.posteriors(psi.copy(), size)
        hot = np.eye(few)[gold.T]
        delta = (post - hot).reshape(-1, few)
        per_word = np.zeros((len(w), few))
        np.add.at(per_word, back.T.ravel(), delta)
        grad = np.stack([np.bincount(inv, np.repeat(per_word[:, j], count), len(uniq)) for j in range(few)], axis=1) / BATCH
        g2[rows] += grad**2
        crf.weights[rows] -= 0.15 * grad / np.sqrt(g2[rows])
        # transitions: gold pairs less expected ones
        gt = (expected_pairs(post, part.trans) - np.einsum("tbi,tbj->ij", hot[:-1], hot[1:])) / BATCH
        gb = (post[0] - hot[0]).sum(axis=0) / BATCH
        square = np.ix_(here, here)
        t2[square] += gt**2
        b2[here] += gb**2
        crf.trans[square] -= 0.05 * gt / np.sqrt(t2[square])
        crf.begin[here] -= 0.05 * gb / np.sqrt(b2[here])
    return crf


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = DOCS) -> Crf | None:
    """Trains on about bound documents of each language, chosen by a hash of their id among those not held out.

    Of a text longer than CHARS a window of so many characters is taken, its place chosen by hash too. The LABELS most
    frequent languages are learned. The driver holds about SAMPLE characters of text and WEIGHTS weights at most: where
    there are more than a few languages, windows shrink (to 500 characters), then documents a language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()  # a row a language
    if not sizes:
        return None
    chars = min(CHARS, max(500, SAMPLE // (bound * len(sizes))))
    bound = max(1, min(bound, SAMPLE // (chars * len(sizes))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, bound / r["count"])) for r in sizes], "lang string, share double")
    start = F.pmod(F.xxhash64(F.lit("window"), F.col("id").cast("string")), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int")
    drawn = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("id", F.substring("text", start + 1, F.lit(chars)).alias("text"), "lang")
    sample = drawn.limit(2 * bound * len(sizes)).collect()
    sample.sort(key=lambda r: (str(r["id"]), r["lang"], zlib.crc32(r["text"].encode("utf-8", "surrogatepass"))))
    return train([(r["text"], r["lang"]) for r in sample])


class Labeller:
    """Applies a trained field to batches of texts."""

    def __init__(self, crf: Crf | None):
        self.crf, self.ids = crf, {}
        self.k = len(crf.langs) if crf else 1
        self.table = np.empty((0, self.k), np.float32)

    def _learn(self, parted: list[list[str]]) -> None:
        if len(self.ids) > CACHE // self.k:
            self.ids, self.table = {}, self.table[:0]
        new = list(set().union(*parted) - self.ids.keys())
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.ids.update(zip(part, range(len(self.ids), len(self.ids) + len(part)), strict=True))
            e = self.crf.emissions(part)
            self.table = np.concatenate((self.table, np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60)).astype(np.float32)))

    def posteriors(self, parted: list[list[str]]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(documents, first word, their words' lengths T x B, 0 beyond the end, posteriors T x B x K)."""
        if self.crf is None or not parted:
            return
        self._learn(parted)
        size = np.array([len(p) for p in parted])
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        lo = 0
        while lo < len(order):
            most = int(size[order[lo]])
            if most * self.k > CELLS:
                d = int(order[lo])
                at, wide = (np.fromiter(map(f, parted[d]), np.int64, most) for f in (self.ids.__getitem__, len))
                block = max(1, CELLS // (4 * self.k))
                for start, post in self.crf.blocks(lambda a, b: self.table[at[a:b]].astype(np.float64), most, block):  # noqa: B023
                    yield order[lo : lo + 1], start, wide[start : start + len(post), None], post[:, None, :]
                lo += 1
                continue
            group = order[lo : lo + max(1, min(TOGETHER, CELLS // (most * self.k)))]
            lo += len(group)
            at, wide = np.zeros((most, len(group)), np.int64), np.zeros((most, len(group)))
            for j, d in enumerate(group.tolist()):
                at[: size[d], j] = np.fromiter(map(self.ids.__getitem__, parted[d]), np.int64, size[d])
                wide[: size[d], j] = np.fromiter(map(len, parted[d]), np.int64, size[d])
            post = self.crf.posteriors(self.table[at].astype(np.float64), size[group])
            post[wide == 0] = 0
            yield group, 0, wide, post

    def languages(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of most posterior mass of each text, and its share."""
        mass = np.zeros((len(texts), self.k))
        for docs, _, wide, post in self.posteriors([words(t) for t in texts]):
            mass[docs] += np.einsum("tb,tbk->bk", wide, post)
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        score = np.minimum(mass.max(axis=1, initial=0) / np.where(total > 0, total, 1), 1.0)
        return [self.crf.langs[b] if t > 0 else NONE for b, t in zip(best.tolist(), total.tolist(), strict=True)], score

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The runs (start, end in characters of the lower-cased text, language) of words of one language."""
        low = [t.lower() if t else "" for t in texts]
        parted = [_pattern(t).findall(t) for t in low]
        best = [np.zeros(len(p), np.int64) for p in parted]
        for docs, start, wide, post in self.posteriors(parted):
            top = post.argmax(axis=2)
            for j, d in enumerate(docs.tolist()):
                n = np.count_nonzero(wide[:, j])
                best[d][start : start + n] = top[:n, j]
        out = []
        for t, b in zip(low, best, strict=True):
            runs: list[tuple[int, int, str]] = []
            for m, x in zip(_pattern(t).finditer(t) if self.crf else (), b.tolist(), strict=self.crf is not None):
                lang = self.crf.langs[x]
                runs[-1:] = [(runs[-1][0], m.end(), lang)] if runs and runs[-1][2] == lang else [*runs[-1:], (m.start(), m.end(), lang)]
            out.append(runs)
        return out


def label(docs: DataFrame, crf: Crf | None, text_col: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the columns pred and score (the share of the best language); other columns of these names are replaced.

    A null text, one without letters, or any text where nothing could be learned is `und` with score 0. Every row comes
    back once, and equal texts get equal results; no rows: no rows. Only the texts are sent to Python.
    """
    spark = tuned(docs.sparkSession)
    held = spark.sparkContext.broadcast(crf)  # 2^17 weights for each language

    @F.arrow_udf("struct<pred string, score double>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(held.value)
        for texts in batches:
            lang, share = labeller.languages(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(share, pa.float64())], ["pred", "score"])
        release()

    own = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    return docs.withColumn(own, best(F.col(text_col))).select(*kept, F.col(f"{own}.pred").alias(pred), F.col(f"{own}.score").alias(score))


def language_spans(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, end, lang): the runs of words that the field gives to one language, in code-switched text.

    start and end are code points of the lower-cased text. Texts without letters, and null ones, have no runs.
    """
    held = tuned(docs.sparkSession).sparkContext.broadcast(crf)

    @F.arrow_udf("array<struct<start long, end long, lang string>>")
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller, kind = Labeller(held.value), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for texts in batches:
            yield pa.array([[dict(zip(("start", "end", "lang"), r, strict=True)) for r in rs] for rs in labeller.spans(texts.to_pylist())], kind)
        release()

    return docs.select(F.col(id_col).alias("id"), runs(F.col(text_col)).alias("runs")).select(F.col("id").alias(id_col), F.inline("runs"))


def op4(docs: DataFrame) -> DataFrame:
    crf = fit(docs)
    out = label(docs.select("doc_id", "text"), crf)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def reject_unknown(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs without those that are `und`, or of which no language holds the least share; all columns stay as they are.

    The least share is LEAD times the even one, so it falls with the number of languages learned. Null texts and texts
    without letters go; rows that repeat stay or go alike; ids may be null. No rows, or nothing to learn from: no rows.
    """
    crf = fit(docs)
    if least is None:
        least = min(LEAST, LEAD / len(crf.langs)) if crf else LEAST
    pred, score = fresh(docs, "pred"), fresh(docs, "score")
    return label(docs, crf, pred=pred, score=score).where((F.col(pred) != NONE) & (F.col(score) >= least)).select(*docs.columns)
