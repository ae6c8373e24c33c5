"""Source divergence audit: how differently the sources of a language use its terms, by tiles of group blocks.

Terms are counted where texts are read and summed by (language, source, term). A language keeps the terms of enough of
its documents; these are dealt into vocabulary chunks by hash and numbered there. A source's counts in a chunk are packed
into one vector, and each language's sources into group blocks. A task for two group blocks gets the vectors of both, a
chunk after the other, and adds up the sums of absolute differences of all its pairs, so it holds two blocks of one chunk
and one submatrix, however large vocabulary and number of sources are. Long vocabularies give several tasks a tile, whose
submatrices Spark adds up. All numbers are integers: a share is floor(10^9 (count + 5) / (N + 5 V)) + 1, by long division.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, tuned

#: Least documents of a kept term, terms that a report lists, and what smooths a share of SCALE.
LEAST_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Sources of a group block, kept terms that a vocabulary chunk is planned for, and chunks that a task of a tile reads.
GROUPS, TERMS, CHUNKS = 64, 2048, 64
#: Distinct (group, term) entries that a counting task holds before it hands them on.
HELD = 400_000

#: Bytes that part terms become spaces, A to Z become a to z; bytes beyond ASCII stay.
_TERMS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _count(batches):
    """Rows (lang, source, term, n, docs) of a task's documents; a null term for each document's group."""
    held: dict[tuple, list] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            made = [pa.array([None, *terms], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, terms)], pa.int64())]
            names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms) + 1, np.int64))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, made[0].cast(pa.string()), *made[1:]], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            own = held.setdefault((lang, source), [Counter(), Counter()])
            words = text.as_buffer().to_pybytes().translate(_TERMS).split()
            size -= len(own[1])
            own[0].update(words)
            own[1].update(set(words))
            size += len(own[1])
            if size > HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row of null term a group.

    Terms are the longest runs of ASCII letters and characters beyond ASCII, A to Z in lower case. Null languages, sources
    and texts are empty ones.
    """
    tuned(docs.sparkSession)
    held = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    made = held.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """floor(SCALE (n + 5) / (total + 5 terms)) + 1, exactly."""
    wide = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + SMOOTH * terms).cast("decimal(20,0)")).cast("long") + 1


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """share() of counts, given total + 5 terms: long division by thousands, which stays within 64 bits."""
    n = n + SMOOTH
    out, rest = n // whole, n % whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _tile(groups: int):
    """Partial submatrices of tiles: rows of one tile come together, its two headers first, then chunk by chunk.

    A header (chunk -1) holds N + 5 V of a block's sources; a vector row a source's packed places and counts.
    """
    def run(batches):
        now, whole, sides, total, chunk = None, {}, {}, None, None

        def settle():
            nonlocal total
            if not sides:
                return
            terms = max(x[1] for side in sides.values() for x in side)
            p = {}
            for side in (0, 1):
                dense = np.zeros((len(whole[side]), terms), np.int64)
                for row, _, at, n in sides.get(side, ()):
                    dense[row, at] = n
                p[side] = shares(dense, whole[side][:, None])
            for i, x in enumerate(p[0]):
                total[i] += np.abs(p[1] - x).sum(axis=1)

        def close():
            settle()
            i, j = np.nonzero(np.ones(total.shape, bool))
            lang, a, b = now[0], now[1] * groups, now[2] * groups
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(i), np.int64))), pa.array(i + a), pa.array(j + b), pa.array(total[i, j])], ["lang", "i", "j", "value"])

        for batch in batches:
            columns = [batch.column(c) for c in ("lang", "a", "b", "part", "chunk", "side", "row", "terms", "at", "n")]
            for *key, c, side, row, terms, at, n in zip(*(x.to_pylist() for x in columns[:8]), *columns[8:], strict=True):
                if key != now:
                    if now is not None:
                        yield close()
                    now, whole, sides, total, chunk = key, {}, {}, None, None
                if c < 0:
                    whole[side] = n.values.to_numpy()
                    if len(whole) == 2:
                        total = np.zeros((len(whole[0]), len(whole[1])), np.int64)
                    continue
                if c != chunk:
                    settle()
                    chunk, sides = c, {}
                sides.setdefault(side, []).append((row, terms, at.values.to_numpy(), n.values.to_numpy()))
        if now is not None:
            yield close()
    return run


class Audit:
    """The tables of an audit: groups (lang, source, total, whole, q_whole, v), kept terms' counts, and both reports."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, terms: int = TERMS):
        counts = cut(term_counts(docs, lang_col, source_col, text_col))
        by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
        sizes = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        # chunks by hash, so that numbering within them needs no task for a whole vocabulary
        chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / terms)).cast("int")
        w = Window.partitionBy("lang", "chunk")
        kept = by_term.join(F.broadcast(sizes), "lang") if sizes.limit(100_001).count() <= 100_000 else by_term.join(sizes, "lang")
        kept = kept.withColumn("chunk", chunk)
        self.kept = cut(kept.select("lang", "term", "lang_n", "v", "lang_total", "chunk", (F.row_number().over(w.orderBy("term")) - 1).alias("at"), F.count("*").over(w).cast("int").alias("terms")))
        self.cells = cut(counts.where("n > 0").join(self.kept, ["lang", "term"]))
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        zero = F.lit(0).cast("long")
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = cut(groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"), number.cast("long").alias("g")))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): each ordered pair of a language's sources and its sum of |p - q|, 0 without kept terms."""
        whole = F.greatest(F.col("total") + SMOOTH * F.col("v"), F.lit(1))
        group = self.groups.select("lang", "source", "g", "v", whole.alias("whole"), F.floor(F.col("g") / GROUPS).cast("long").alias("block"))
        blocks = cut(group.groupBy("lang", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "whole"))), lambda x: x["whole"]).alias("wholes"), F.max("v").alias("v")))  # GROUPS entries each
        langs = blocks.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"), F.max("v").alias("v"))
        chunks = self.kept.groupBy("lang").agg(F.max("chunk").alias("last"))
        langs = small(cut(langs.join(chunks, "lang", "left").select("lang", "n_blocks", F.floor(F.coalesce("last", F.lit(0)) / CHUNKS).cast("int").alias("last_part"))), width=48)

        def dealt(rows: DataFrame, parts: Column) -> DataFrame:
            """A row for each tile (a <= b) of its block, on one side or on both."""
            rows = rows.join(langs, "lang").withColumn("part", F.explode(parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
            rows = rows.withColumn("side", F.explode(F.when(F.col("other") == F.col("block"), F.array(F.lit(0), F.lit(1))).when(F.col("other") > F.col("block"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))))
            return rows.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "part", "chunk", "side", "row", "terms", "at", "n")

        none = F.array().cast("array<int>")
        heads = dealt(blocks.select("lang", "block", F.lit(-1).alias("chunk"), F.lit(0).alias("row"), F.lit(0).alias("terms"), none.alias("at"), F.col("wholes").alias("n")), F.sequence(F.lit(0), F.col("last_part")))
        packed = self.cells.groupBy("lang", "source", "chunk").agg(F.first("terms").alias("terms"), F.collect_list(F.struct("at", "n")).alias("c"))  # a chunk's terms at most
        packed = packed.join(group.select("lang", "source", "g", "block"), ["lang", "source"]).select(
            "lang", "block", "chunk", (F.col("g") % GROUPS).cast("int").alias("row"), "terms", F.col("c.at").alias("at"), F.col("c.n").alias("n"))
        packed = dealt(packed, F.array(F.floor(F.col("chunk") / CHUNKS).cast("int")))
        tiles = heads.unionByName(packed).repartition("lang", "a", "b", "part").sortWithinPartitions("lang", "a", "b", "part", "chunk", "side", "row")
        sums = tiles.mapInArrow(_tile(GROUPS), "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        both = sums.where("i <> j").select("lang", F.explode(F.when(F.floor(F.col("i") / GROUPS) == F.floor(F.col("j") / GROUPS), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("p"), "value")
        names = small(cut(self.groups.select("lang", "source", "g")), width=96)
        named = both.select("lang", "p.i", "p.j", "value").join(names.select("lang", "source", F.col("g").alias("i")), ["lang", "i"]).join(names.select("lang", F.col("source").alias("item"), F.col("g").alias("j")), ["lang", "j"])
        # languages without kept terms have shares of nothing
        return named.select("lang", "source", "item", "value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value): each kept term that a source uses more than its language does, by how much."""
        totals = small(cut(self.groups.select("lang", "source", "total")), width=96)
        p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        return self.cells.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source all others by distance, and its top terms by excess.

    Ranks count from 1 by descending value, then ascending item. Nulls are empty strings, and so a language or a source of
    their own; repeated rows count each; a source without terms is compared like any other; a language of one source has
    no pairs. Columns other than the three named aren't read. No rows: no rows. All pairs of a language's sources are the
    result, so it grows with the square of their number; the documents behind a source don't matter for that.
    """
    found = Audit(docs, lang_col, source_col, text_col, least_docs, terms)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(w)
    pairs = found.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return pairs.unionByName(found.terms().select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top))


def op13(docs: DataFrame) -> DataFrame:
    return audit(docs)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS toks FROM documents),
per_doc AS (SELECT lang, source, doc_id, translate(unnest(toks), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT lang, source, toks, row_number() OVER () AS doc_id FROM d)),
one AS (SELECT lang, source, term, doc_id, count(*) AS n FROM per_doc GROUP BY ALL),
c AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n, count(*) AS docs FROM one GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
ns AS (SELECT lang, source, sum(n) AS total FROM c JOIN kept USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(ns.total, 0) + 5 * vs.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (k.lang_n + 5)) // (vs.total + 5 * vs.v) AS BIGINT) AS q
  FROM g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 50
"""
