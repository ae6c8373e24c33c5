"""MinHash near-dedup by HyperMinHash registers.

Each document's distinct five-word shingles are hashed once. The top bits of a hash choose one of 128 buckets; of the
least hash in a bucket only the count of leading zeros and ten mantissa bits are kept (a HyperMinHash register). Empty
buckets borrow the register of another one by a fixed random order. Bands of five registers give candidates, a
collision-corrected estimate of the Jaccard similarity discards hopeless ones, and the full sets decide.

Equal sets are one class from the start, so a group of copies costs one representative. In each band bucket members are
first compared with its first member; only buckets that the components so found still tear are compared within, and only
across components: in blocks of bounded size, first by registers, then those with plausible partners on full sets, which
return edges between components, so that no bucket's pairs are ever emitted.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh, release, roots, small, tuned

WORDS = 5
BUCKETS = 128
MANTISSA = 10
BAND = 5
BANDS = BUCKETS // BAND
#: Members of a band bucket that are compared in one block.
BLOCK = 256
#: Distinct words whose hashes a worker keeps.
CACHE = 200_000
#: Standard deviations that the estimate may lie below the threshold before a candidate is discarded.
SLACK = 5.5

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: bijective, so distinct inputs stay distinct."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash; forgets everything when it grows past CACHE."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: all runs of so many words, or all its words if they are fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * _MULT[i % 5] ^ np.uint64(i * 0x51ED2701)
    return np.unique(mix(h))


@lru_cache(maxsize=1)
def _borrow() -> np.ndarray:
    """For every bucket the order in which it looks for a bucket to borrow from when it is empty."""
    rng = np.random.default_rng(20240601)
    return np.array([np.concatenate(([i], rng.permutation([j for j in range(BUCKETS) if j != i]))) for i in range(BUCKETS)])


_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)


def registers(h: np.ndarray) -> np.ndarray:
    """128 registers (leading zeros << 10 | mantissa) of a non-empty sorted set of hashes."""
    at = np.searchsorted(h, _EDGES)
    full = np.diff(at, append=len(h)) > 0
    rest = h[np.minimum(at, len(h) - 1)] << np.uint64(7) | np.uint64(1)
    exponent = np.frexp(rest.astype(np.float64))[1]  # 1..64; rounding up to the next power is the same for equal hashes
    zeros = (64 - np.minimum(exponent, 64)).astype(np.uint64)
    lead = rest << zeros
    mantissa = (lead >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    reg = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if not full.all():
        order = _borrow()
        reg = reg[order[np.arange(BUCKETS), full[order].argmax(axis=1)]]
    return reg


def bands(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    x = reg[: BANDS * BAND].reshape(BANDS, BAND).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        h = mix(h * _MULT[0] + x[:, i])
    return h.view(np.int64)


def estimate(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the count of equal registers, less the share that collide by chance.

    Two unrelated buckets with rates a and b collide about 0.72 * 2^-10 * a * b / (a + b)^2 of the time.
    """
    c = 0.72 * 2.0**-MANTISSA * n_a * n_b / np.square(np.maximum(n_a + n_b, 1).astype(float))
    return (same / BUCKETS - c) / (1 - c)


def plausible(same, n_a, n_b, percent: int):
    """False only where sizes or the estimate rule out a similarity of percent / 100."""
    n_a, n_b = np.asarray(n_a, np.int64), np.asarray(n_b, np.int64)
    s = percent / 100
    sd = np.sqrt(s * (1 - s) / np.minimum(BUCKETS, np.minimum(n_a, n_b).clip(1)))
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (estimate(same, n_a, n_b) >= s - SLACK * sd)


def prints(h: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit sums that stand for a set of hashes; different sets agree with a chance of 2^-128."""
    return len(h), int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0, int(mix(h ^ _MULT[1]).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0


def _sketch(words: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes, words) for t in batch.column(2).to_pylist()]
            held = [pa.array(x, pa.int64()) for x in zip(*map(prints, sets), strict=True)] if sets else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *held, pa.array([registers(h).tobytes() if len(h) else None for h in sets], pa.binary())], ["id", "th", "n", "fa", "fb", "sig"])
        release()
    return run


def _band_rows(batches):
    for batch in batches:
        ids, sigs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        if len(ids):
            keys = np.concatenate([bands(np.frombuffer(s, np.uint16)) for s in sigs])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, BANDS))], ["key", "id"])


def _pair_filter(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, sa, na, sb, nb = batch.columns
            x = np.frombuffer(b"".join(sa.to_pylist()), np.uint16).reshape(-1, BUCKETS)
            y = np.frombuffer(b"".join(sb.to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keep = plausible((x == y).sum(axis=1), na.to_numpy(), nb.to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))
    return run


def _sets(words: int):
    """(id, n, fa, fb, set) of texts."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes, words) for t in batch.column(1).to_pylist()]
            held = [pa.array(x, pa.int64()) for x in zip(*map(prints, sets), strict=True)] if sets else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *held, pa.array([h.tobytes() for h in sets], pa.binary())], ["id", "n", "fa", "fb", "set"])
        release()
    return run


def _star_links(percent: int):
    """Rows (head, chunk, id, set), a head's own row (no id) before its members: the members linked with the head."""
    def run(batches):
        head, held = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for h, i, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if i is None:
                    head, held = h, x.copy()
                elif h == head:
                    both = len(np.intersect1d(x, held, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(held) - both):
                        a.append(h)
                        b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of which sets of x and y are similar enough. Only hashes of both sides are counted, some columns at a time."""
    nx, ny = (np.array([len(s) for s in z]) for z in (x, y))
    ox, oy = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    fx, fy = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(fx, fy)
    both = np.zeros((len(x), len(y)), np.float32)
    if len(common):
        def columns(flat, owner):
            at = np.searchsorted(common, flat)
            ok = common[np.minimum(at, len(common) - 1)] == flat
            order = np.argsort(at[ok], kind="stable")
            return at[ok][order], owner[ok][order]

        (cx, ox), (cy, oy) = columns(fx, ox), columns(fy, oy)
        step = 4096
        for lo in range(0, len(common), step):
            parts = []
            for c, o, n in ((cx, ox, len(x)), (cy, oy, len(y))):
                a, b = np.searchsorted(c, (lo, lo + step))
                m = np.zeros((n, step), np.float32)
                m[o[a:b], c[a:b] - lo] = 1
                parts.append(m)
            both += parts[0] @ parts[1].T
    return (both > 0) & (100 * both.astype(np.float64) >= percent * (nx[:, None] + ny[None, :] - both))


GROUP = ("key", "bi", "bj")


def _groups(batches):
    """Tables of whole groups (key, bi, bj) from rows sorted by them; a group has at most two blocks of members."""
    def place(batch, k):
        return tuple(batch.column(c)[k].as_py() for c in GROUP)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        end = place(batch, batch.num_rows - 1)
        if place(held[0], 0) == end:
            continue  # still the same group
        table = pa.Table.from_batches(held)
        inside = np.logical_and.reduce([table.column(c).to_numpy() == e for c, e in zip(GROUP, end, strict=True)])
        start = int(inside.argmax())
        yield table.slice(0, start)
        held = table.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _sides(table):
    """For each group: its rows' range, and where its two sides lie within (both the same where a block meets itself)."""
    cols = [table.column(k).to_numpy() for k in GROUP]
    new = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
    side = table.column("side").to_numpy()
    for x, y in zip(new, np.r_[new[1:], table.num_rows], strict=True):
        own = side[x:y]
        left, right = np.flatnonzero(own == cols[1][x]), np.flatnonzero(own == cols[2][x])
        if len(left) and len(right):
            yield x, y, left, right


def _close(percent: int):
    """Groups of signatures: the members with a plausible partner of another component on the other side."""
    def run(batches):
        for table in _groups(batches):
            comp, n, sig = table.column("comp").to_numpy(), table.column("n").to_numpy(), table.column("sig")
            keep = np.zeros(table.num_rows, bool)
            for x, y, left, right in _sides(table):
                reg = np.frombuffer(b"".join(sig.slice(x, y - x).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
                apart = comp[x + a] != comp[x + b]
                a, b = a[apart], b[apart]
                for lo in range(0, len(a), 8192):
                    p, q = a[lo : lo + 8192], b[lo : lo + 8192]
                    ok = plausible((reg[p] == reg[q]).sum(axis=1), n[x + p], n[x + q], percent)
                    keep[x + p[ok]] = keep[x + q[ok]] = True
            yield from table.select([*GROUP, "side", "node", "comp"]).filter(pa.array(keep)).combine_chunks().to_batches()
    return run


def _block_links(percent: int):
    """Groups of sets: edges that join the components which links between the two sides connect."""
    def run(batches):
        for table in _groups(batches):
            comp, raw = table.column("comp").to_numpy(), table.column("set")
            for x, y, left, right in _sides(table):
                c, at = np.unique(comp[x:y], return_inverse=True)
                if len(c) > 1:
                    sets = [np.frombuffer(s, np.uint64) for s in raw.slice(x, y - x).to_pylist()]
                    i, j = np.nonzero(linked([sets[k] for k in left], [sets[k] for k in right], percent))
                    root = roots(len(c), at[left[i]], at[right[j]])
                    own = np.flatnonzero(root != np.arange(len(c)))
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(c[root[own]])], ["a", "b"])
    return run


def _blocked(apart: DataFrame) -> DataFrame:
    """Rows (key, bi, bj, side, node, comp) of the torn buckets' members, a row for each block that they meet in.

    The members of a bucket's largest component needn't meet one another, so they are dealt to blocks of their own, and
    each of these meets the blocks of the rest only: a large linked group with a few strays costs what it has members.
    """
    sizes = apart.groupBy("key", "comp").agg(F.count("*").alias("s"))
    top = sizes.groupBy("key").agg(F.max(F.struct("s", "comp")).alias("t"), F.sum("s").alias("m")).where("m > t.s").select(
        "key", F.col("t.comp").alias("top"), F.ceil(F.col("t.s") / BLOCK).cast("int").alias("nt"), F.ceil((F.col("m") - F.col("t.s")) / BLOCK).cast("int").alias("nr"))
    met = apart.join(top, "key")
    large = F.col("comp") == F.col("top")
    side = F.when(large, F.col("nr") + F.pmod(F.xxhash64("node"), F.col("nt"))).otherwise(F.pmod(F.xxhash64("node"), F.col("nr"))).cast("int")
    others = F.when(large, F.sequence(F.lit(0), F.col("nr") - 1)).otherwise(F.sequence(F.lit(0), F.col("nr") + F.col("nt") - 1))
    met = met.select("key", "node", "comp", side.alias("side"), F.explode(others).alias("o"))
    return met.select("key", F.least("side", "o").alias("bi"), F.greatest("side", "o").alias("bj"), "side", "node", "comp")


def _classified(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, n, node) of docs (id, text), and (node, rep, root) of classes of equal sets; th is a hash of the text.

    A class is known by a number of its own, rep is the least id of its rows, and root the number of its component.
    """
    spark = tuned(docs.sparkSession)
    docs = docs.withColumn("th", F.xxhash64("text"))
    sigs = cut(docs.select("id", "th", "text").mapInArrow(_sketch(words), "id long, th long, n long, fa long, fb long, sig binary"))
    classes = cut(sigs.where("n > 0").groupBy("fa", "fb", "n").agg(F.min("id").alias("rep"), F.min("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))
    sig = classes.where("rep is not null").select("node", "sig", "n")
    rows = sig.select("node", "sig").mapInArrow(_band_rows, "key long, node long")
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("other")).where("head < other").select("key", "head")
    cand = cut(rows.join(heads, "key"))
    star = cand.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    x, y = (sig.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    star = cut(star.join(x, "a").join(y, "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(_pair_filter(percent), "a long, b long"))

    def sets(nodes: DataFrame) -> DataFrame:
        """(node, set) of the classes named in the cut column node, by the text of their least id."""
        need = cut(classes.drop("sig").join(nodes.distinct(), "node"))
        ids = cut(need.select(F.col("rep").alias("need")).distinct())
        texts = docs.join(small(ids), F.col("id") == F.col("need"), "left_semi").dropDuplicates(["id", "th"]).select("id", "text")
        made = texts.mapInArrow(_sets(words), "id long, n long, fa long, fb long, set binary")
        return made.join(need.withColumnRenamed("rep", "id"), ["id", "n", "fa", "fb"]).select("node", "set")

    # heads meet their members: a head's set is sent once for each chunk of members, a member's once for each head
    own = cut(sets(star.select(F.explode(F.array("a", "b")).alias("node"))).dropDuplicates(["node"]))
    chunks = star.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nc"))
    members = star.join(chunks, "a").join(own, F.col("b") == F.col("node")).select("a", F.pmod(F.xxhash64("b"), F.col("nc")).cast("int").alias("chunk"), "b", "set")
    tops = chunks.join(own, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "set")
    met = tops.unionByName(members).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    comp = cut(components(met.mapInArrow(_star_links(percent), "a long, b long")))
    # what the stars left apart: members of one bucket in different components
    apart = cand.join(comp.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component_id", "node").alias("comp"))
    torn = apart.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("d")).where("c1 < c2 and m > 2")
    # buckets of the same members give the same pairs: those with equal digests are compared once
    once = torn.groupBy("d", "m").agg(F.min("key").alias("key")).select("key")
    blocks = _blocked(cut(apart.join(once, "key")))
    by = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP)
    close = cut(by(blocks.join(sig, "node").select(*GROUP, "side", "node", "comp", "n", "sig")).mapInArrow(_close(percent), "key long, bi int, bj int, side int, node long, comp long"))
    if close.limit(1).count():
        held = sets(close.select("node")).dropDuplicates(["node"])
        extra = cut(by(close.join(held, "node").select(*GROUP, "side", "comp", "set")).mapInArrow(_block_links(percent), "a long, b long").distinct())
        if extra.limit(1).count():
            comp = cut(components(extra.unionAll(comp.select(F.col("id").alias("a"), F.col("component_id").alias("b")))))
    known = classes.drop("sig").join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component_id", "node"))
    rows = sigs.drop("sig").join(known.select("fa", "fb", "n", "node"), ["fa", "fb", "n"], "left")
    return rows.select("id", "th", "n", "node"), known.select("node", "rep", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one for each row of docs.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of word shingles (A-Z lower-cased,
    words parted by ASCII white space). component_id is the least id reachable, kept says that it is the row's own.
    Sets are compared by 64-bit hashes of their shingles; equal sets are known by their size and two 64-bit sums, which
    agree for two different sets with a chance of 2^-128. Null, empty or blank texts have no set and stay alone; texts
    of fewer words have one shingle of all of them. Rows with a null id keep their row: they carry the component of an
    equal set that has an id, else none (null, kept). Rows that share an id but not their text are documents of their
    own with that id. Other columns aren't read. No rows: no rows.
    """
    rows, classes = _classified(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), words, percent)
    least = classes.groupBy("root").agg(F.min("rep").alias("component"))
    out = rows.join(classes.join(least, "root").select("node", "component"), "node", "left")
    own: Column = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id").eqNullSafe(own), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 80) -> DataFrame:
    """docs with one row of each component of near_duplicates(); all columns stay, whatever their names.

    The row with the least id stays (a null id last), then the one with the least hash of the text; of rows that repeat
    id and text any one. Rows without words (null, empty or blank texts) are no copies of one another and all stay.
    """
    rows, classes = _classified(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), words, percent)
    rows = rows.where("n > 0").join(classes.select("node", "root"), "node").select("root", "id", "th")
    many = rows.groupBy("root", "id", "th").agg(F.count("*").alias("m"))
    many = cut(many.join(many.groupBy("root").agg(F.sum("m").alias("all")).where("all > 1").select("root"), "root"))
    first = many.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("f")).select("root", "f.id", "f.th")
    best = many.join(first.select("root", F.col("id").alias("bi"), F.col("th").alias("bt")), "root").withColumn("best", F.col("id").eqNullSafe(F.col("bi")) & (F.col("th") == F.col("bt")))
    touched = cut(best.where("not best or m > 1").select(F.col("id").alias("gi"), F.col("th").alias("gt"), "best"))
    ti, th, gi, gt = (fresh(docs, c) for c in ("touched_id", "touched_hash", "gone_id", "gone_hash"))
    both = docs.select("*", F.col(id_col).cast("long").alias(ti), F.xxhash64(text_col).alias(th))
    match = F.col(ti).eqNullSafe(F.col(gi)) & (F.col(th) == F.col(gt))
    named = touched.withColumnsRenamed({"gi": gi, "gt": gt})
    left = both.join(small(named.drop("best"), width=24), match, "left_anti")
    repeated = both.join(small(named.where("best").drop("best"), width=24), match, "left_semi").dropDuplicates([ti, th])
    return left.unionByName(repeated).select(*docs.columns)
