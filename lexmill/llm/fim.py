"""Fill-in-middle transformation by a parallel automaton scan.

A small automaton reads a text's code points: it tells where tokens start and whether a control string occurs. A block of
code points doesn't know in which state it is entered, so it emits a function: for each entry state the state it leaves
in, how many tokens start and how many control strings end. Such functions compose associatively, so a doubling scan over
the blocks gives every block its entry state and every token count, all blocks of a batch at once. A cut, the start of the
k-th token, is then selected by its count: only the block that holds it is read again. Texts stay where they lie.

A giant document is dealt out: its chunks are rows of their own, scanned anywhere, only their functions come together
to be composed, and the chunks that hold a cut are found by a join and searched. Both ways run the same code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small, tuned

#: Code points of a block, and blocks that are scanned at once.
BLOCK, TOGETHER = 512, 4096
#: Texts of more bytes are dealt out in chunks of so many code points.
GIANT, CHUNK = 8 << 20, 1 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Automaton:
    """Next states and emissions for (state, class of a code point); the last class is padding, which changes nothing.

    A unit starts where starts[state, class] is 1, a mark ends where marks[state, class] is. Code points beyond the
    table of classes are of the class of its last entry.
    """

    def __init__(self, classes: np.ndarray, step: np.ndarray, starts: np.ndarray, marks: np.ndarray):
        self.states, known = step.shape
        self.width = known + 1
        self.classes, self.pad = classes.astype(np.uint8), known
        own = np.arange(self.states)[:, None]
        self.step = np.hstack((step, own)).astype(np.int16).ravel()
        self.next_key = (self.step * self.width).astype(np.int16)  # a state as the place of its row
        zero = np.zeros((self.states, 1), int)
        # one number holds both counts: a block has far fewer than 2^16 of either
        self.emit = (np.hstack((starts, zero)) + (np.hstack((marks, zero)) << 16)).astype(np.int32).ravel()

    def blocks(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes (BLOCK x blocks) of documents that follow one another in codes, and how many blocks each has (1 at least)."""
        n = np.maximum(1, -(-length // BLOCK))
        doc = np.repeat(np.arange(len(length)), n)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = (np.cumsum(length) - length)[doc] + inside * BLOCK
        size = np.minimum(BLOCK, length[doc] - inside * BLOCK)
        own = self.classes[np.minimum(codes, len(self.classes) - 1)]
        at = first[None, :] + np.arange(BLOCK)[:, None]
        held = np.arange(BLOCK)[:, None] < size[None, :]
        out = np.full(at.shape, self.pad, np.uint8)
        out[held] = own[at[held]]
        return out, n

    def functions(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each state and block (states x blocks): the state it leaves in, units that start, marks that end."""
        s, b = self.states, classes.shape[1]
        ends, units, marks = (np.empty((s, b), t) for t in (np.int16, np.int64, np.int64))
        for lo in range(0, b, TOGETHER):
            part = classes[:, lo : lo + TOGETHER]
            row = np.repeat(np.arange(s, dtype=np.int16)[:, None] * np.int16(self.width), part.shape[1], axis=1)
            total = np.zeros(row.shape, np.int32)
            for c in part:
                key = row + c
                total += self.emit.take(key)
                row = self.next_key.take(key)
            ends[:, lo : lo + TOGETHER], units[:, lo : lo + TOGETHER], marks[:, lo : lo + TOGETHER] = row // self.width, total & 0xFFFF, total >> 16
        return ends, units, marks

    def search(self, classes: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place in each block (column) of the unit start that rank earlier ones precede, entered in the given state."""
        row, left, place = state.astype(np.int16) * np.int16(self.width), rank.astype(np.int64) + 1, np.full(len(rank), -1, np.int64)
        for j, c in enumerate(classes):
            key = row + c
            left -= self.emit.take(key) & 0xFFFF
            place[(left == 0) & (place < 0)] = j
            row = self.next_key.take(key)
        return place


def compose(ends: np.ndarray, units: np.ndarray, marks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inclusive scan of functions (states x blocks) by composition; first marks the blocks that open a document.

    Doubling: after round k each block's function reaches back over 2^k blocks, or to its document's first.
    """
    ends, units, marks, whole = ends.copy(), units.copy(), marks.copy(), first.copy()
    reach = 1
    while not whole.all():
        b = np.flatnonzero(~whole)
        a = b - reach
        mid = ends[:, a]
        units[:, b], marks[:, b], ends[:, b] = (units[:, a] + np.take_along_axis(units[:, b], mid, 0), marks[:, a] + np.take_along_axis(marks[:, b], mid, 0), np.take_along_axis(ends[:, b], mid, 0))
        whole[b] |= whole[a]
        reach *= 2
    return ends, units, marks


def fill_in_middle() -> Automaton:
    """Units are runs of ASCII letters and single other characters; marks are `<P>`, `<S>` and `<M>`.

    States: after another character, in a run of letters, after "<", after "<" and one of P, S, M. Classes: others,
    letters, "<", P S M, ">".
    """
    classes = np.zeros(129, int)
    for c in range(128):
        classes[c] = 3 if chr(c) in "PSM" else 1 if chr(c).isalpha() else {"<": 2, ">": 4}.get(chr(c), 0)
    step = np.array([[0, 1, 2, 1, 0], [0, 1, 2, 1, 0], [0, 1, 2, 3, 0], [0, 1, 2, 1, 0]])
    starts = np.array([[1, 1, 1, 1, 1], [1, 0, 1, 0, 1], [1, 1, 1, 1, 1], [1, 0, 1, 0, 1]])
    marks = np.zeros((4, 5), int)
    marks[3, 4] = 1
    return Automaton(classes, step, starts, marks)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), length


def _targets(n: np.ndarray, draw1: np.ndarray, draw2: np.ndarray) -> np.ndarray:
    """Units before the first and before the second cut (2 x documents)."""
    both = np.stack((draw1 % (n + 1), draw2 % (n + 1)))
    return np.sort(both, axis=0)


def scan(auto: Automaton, texts: list[str], draw1: np.ndarray, draw2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, marks, cuts in code points: 2 x documents) of whole texts."""
    codes, length = _codes(texts)
    classes, count = auto.blocks(codes, length)
    head = np.cumsum(count) - count
    first = np.zeros(classes.shape[1], bool)
    first[head] = True
    ends, units, marks = compose(*auto.functions(classes), first)
    last = head + count - 1
    n, hits = units[0, last], marks[0, last]
    goal = _targets(n, draw1, draw2)
    place = np.tile(length, (2, 1))  # a cut after the last unit
    before = np.cumsum(n) - n  # units of the documents before, so that counts rise over all blocks
    rising = units[0] + np.repeat(before, count)
    row, doc = np.nonzero(goal < n)
    rank = goal[row, doc] + before[doc]
    block = np.searchsorted(rising, rank, side="right")
    inner = block - 1
    opens = first[block]
    state = np.where(opens, 0, ends[0, inner])
    earlier = np.where(opens, before[doc], rising[inner])
    for lo in range(0, len(block), TOGETHER):
        at = slice(lo, lo + TOGETHER)
        found = auto.search(classes[:, block[at]], state[at], (rank - earlier)[at])
        place[row[at], doc[at]] = (block[at] - head[doc[at]]) * BLOCK + found
    return n, hits, place


KIND = pa.struct([("n", pa.int64()), ("marks", pa.int64()), ("cut1", pa.int64()), ("cut2", pa.int64())])
KIND_SQL = "struct<n long, marks long, cut1 long, cut2 long>"


def _parts(texts: list[str], most: int = BLOCK * TOGETHER) -> Iterator[slice]:
    """Runs of texts of about most code points."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += max(len(t), BLOCK)
        if held >= most or i + 1 == len(texts):
            yield slice(lo, i + 1)
            lo, held = i + 1, 0


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    auto = fill_in_middle()
    for text, draw1, draw2 in batches:
        texts, h1, h2 = text.to_pylist(), draw1.to_numpy(zero_copy_only=False), draw2.to_numpy(zero_copy_only=False)
        texts = [t or "" for t in texts]
        done = [scan(auto, texts[p], h1[p], h2[p]) for p in _parts(texts)]
        n, hits = (np.concatenate([d[k] for d in done] or [np.empty(0, np.int64)]) for k in (0, 1))
        place = np.concatenate([d[2] for d in done] or [np.empty((2, 0), np.int64)], axis=1)
        yield pa.StructArray.from_arrays([pa.array(n), pa.array(hits), pa.array(place[0]), pa.array(place[1])], fields=list(KIND))
    release()


def _chunks(size: int):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                for k, lo in enumerate(range(0, len(t), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([k], pa.int32()), pa.array([t[lo : lo + size]], pa.string())], ["key", "chunk", "piece"])
    return run


def _summaries(batches):
    auto = fill_in_middle()
    for batch in batches:
        for i in range(batch.num_rows):
            codes, length = _codes([batch.column(2)[i].as_py()])
            classes, count = auto.blocks(codes, length)
            ends, units, marks = (x[:, -1] for x in compose(*auto.functions(classes), np.arange(count[0]) == 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array(length), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ends, units, marks))],
                ["key", "chunk", "length", "ends", "units", "marks"])


SUMMARY = "key binary, chunk int, length long, ends array<long>, units array<long>, marks array<long>"
FOUND = "key binary, n long, marks long, which int, chunk int, base long, state int, rank long"


def _resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """Composes the functions of one document's chunks; a row a cut: the chunk that holds it, its entry state and rank."""
    rows = rows.sort_values("chunk")
    ends, units, marks = (np.stack(rows[c].to_list(), axis=1).astype(np.int64) for c in ("ends", "units", "marks"))
    first = np.arange(len(rows)) == 0
    out, total, hits = compose(ends, units, marks, first)
    rising, n = total[0], int(total[0, -1])
    base = (rows["length"].cumsum() - rows["length"]).to_numpy()
    goal = _targets(np.array([n]), rows["h1"].to_numpy()[:1], rows["h2"].to_numpy()[:1])[:, 0]
    made = []
    for which, k in enumerate(goal.tolist()):
        c = int(np.searchsorted(rising, k, side="right"))
        if c == len(rows):  # after the last unit
            made.append((rows["key"].iloc[0], n, int(hits[0, -1]), which, -1, int(rows["length"].sum()), 0, 0))
        else:
            made.append((rows["key"].iloc[0], n, int(hits[0, -1]), which, int(rows["chunk"].iloc[c]), int(base[c]), int(out[0, c - 1]) if c else 0, k - (int(rising[c - 1]) if c else 0)))
    return pd.DataFrame(made, columns=["key", "n", "marks", "which", "chunk", "base", "state", "rank"])


def _select(batches):
    """The place of each cut within its chunk."""
    auto = fill_in_middle()
    for batch in batches:
        places = []
        for piece, state, rank in zip(batch.column("piece"), batch.column("state").to_pylist(), batch.column("rank").to_pylist(), strict=True):
            codes, length = _codes([piece.as_py()])
            classes, count = auto.blocks(codes, length)
            ends, units, _ = compose(*auto.functions(classes), np.arange(count[0]) == 0)
            b = int(np.searchsorted(units[state], rank, side="right"))
            inside = auto.search(classes[:, [b]], np.array([ends[state, b - 1] if b else state]), np.array([rank - (units[state, b - 1] if b else 0)]))
            places.append(b * BLOCK + int(inside[0]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "marks", "which")), pc.add(batch.column("base"), pa.array(places, pa.int64()))], ["key", "n", "marks", "which", "cut"])


def _giant_cuts(giants: DataFrame, chunk: int) -> DataFrame:
    """(key, found: struct) of giants (key, h1, h2, text), one row a key. Rows that repeat id and text have one key."""
    pieces = cut(giants.select("key", "text").mapInArrow(_chunks(chunk), "key binary, chunk int, piece string").repartition("key", "chunk").dropDuplicates(["key", "chunk"]))
    draws = giants.groupBy("key").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    cuts = cut(pieces.mapInArrow(_summaries, SUMMARY).join(draws, "key").groupBy("key").applyInPandas(_resolve, FOUND))
    held = pieces.join(small(cuts.where("chunk >= 0"), width=96), ["key", "chunk"]).select("key", "n", "marks", "which", "base", "state", "rank", "piece")
    places = held.mapInArrow(_select, "key binary, n long, marks long, which int, cut long").unionAll(cuts.where("chunk < 0").select("key", "n", "marks", "which", "base"))
    one = places.groupBy("key").agg(F.first("n").alias("n"), F.first("marks").alias("marks"), F.max(F.when(F.col("which") == 0, F.col("cut"))).alias("cut1"), F.max(F.when(F.col("which") == 1, F.col("cut"))).alias("cut2"))
    return one.select("key", F.struct("n", "marks", "cut1", "cut2").alias("found"))


def draws(id_: Column, salt: str = "1") -> list[Column]:
    """Four numbers below 2^32 that follow from an id: groups of the sha256 of `salt:id`. A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def build(text: Column, form: Column, cut1: Column, cut2: Column) -> Column:
    """The training text of a form. The middle begins at code point cut1, the suffix at cut2."""
    prefix, middle, suffix = F.substring(text, F.lit(1), cut1), F.substring(text, cut1 + 1, cut2 - cut1), F.substring(text, cut2 + 1, F.char_length(text))
    return (F.when(form == PSM, F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
            .when(form == SPM, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text))


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output: its parts, read between the control strings, in their first order."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == PSM, F.concat(parts[1], parts[3], parts[2])).when(form == SPM, F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20, salt: str = "1", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, restored): one row for each of docs, in their own places.

    A text is cut before units whose numbers follow from the id alone, so a task that runs again makes the same cut. Null
    and empty texts, texts that hold a control string, and plain_percent of the others stay plain, and have no
    prefix_chars and middle_chars. Rows that repeat an id are documents of their own with the same draws; a null id
    draws as an empty one. Other columns aren't read, whatever their names; no rows: no rows. Texts of more than giant
    bytes are dealt out in chunks of chunk code points.
    """
    tuned(docs.sparkSession)
    h1, h2, h3, h4 = draws(F.col("id"), salt)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", "text", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    large = F.octet_length("text") > giant
    whole = rows.where(~large).withColumn("found", F.arrow_udf(_cuts, KIND_SQL)("text", "h1", "h2"))
    giants = rows.where(large).withColumn("key", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), 256)))
    if giants.select("h1").isEmpty():
        done = whole
    else:
        done = whole.unionByName(giants.join(small(cut(_giant_cuts(giants, chunk)), width=96), "key").drop("key"))
    plain = (F.col("found.n") == 0) | (F.col("found.marks") > 0) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, PLAIN).when(F.col("h4") % 100 < spm_percent, SPM).otherwise(PSM)
    c1, c2 = F.col("found.cut1").cast("int"), F.col("found.cut2").cast("int")
    done = done.select("id", "text", F.col("found.n").alias("n"), form.alias("form"), c1.alias("c1"), c2.alias("c2"))
    cutting = F.col("form") != PLAIN
    made = done.select("id", "n", "form", F.when(cutting, F.col("c1")).cast("long").alias("prefix_chars"), F.when(cutting, F.col("c2") - F.col("c1")).cast("long").alias("middle_chars"),
                       build(F.col("text"), F.col("form"), F.col("c1"), F.col("c2")).alias("output"))
    return made.withColumn("restored", restore(F.col("output"), F.col("form")))


def op11(docs: DataFrame) -> DataFrame:
    made = transform(docs)
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS toks, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, text, toks, CAST(len(toks) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
v AS (
  SELECT doc_id, text, toks, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(toks[1:a], ''), '') AS p, coalesce(array_to_string(toks[a + 1:b], ''), '') AS m, coalesce(array_to_string(toks[b + 1:n], ''), '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM w
"""
