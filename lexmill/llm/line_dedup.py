"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Lines are hashed where they are read; three consecutive line hashes make a window. Only windows (two hashes, document,
position) are kept and shuffled: the first place of each repeated window is a minimum that every task pre-aggregates,
and the other places are found by a join against the repeated windows alone. Their positions come back to the document
as one set, so overlapping windows merge, and the lines that no window covers are put together again. Texts are shuffled
only where the sets of positions are too many to be sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small

WINDOW = 3


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """(id, th, pos, h1, h2) of each window that isn't wholly blank."""
    lines = F.split(F.col("text"), "\n")
    hashed = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "th", F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), (F.trim(x) == "").cast("int").alias("blank"))).alias("l"))

    def at(i: Column, k: int) -> Column:
        return F.get("l", i + F.lit(k))

    def build(i: Column) -> Column:
        rows = [at(i, k) for k in range(window)]
        return F.struct(i.alias("pos"), F.xxhash64(*[r["a"] for r in rows]).alias("h1"), F.xxhash64(*[r["b"] for r in rows]).alias("h2"),
                        sum((r["blank"] for r in rows[1:]), rows[0]["blank"]).alias("blanks"))

    return (hashed.where(F.size("l") >= window)
            .select("id", "th", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - window), build)).alias("w"))
            .where(F.col("w.blanks") < window).select("id", "th", "w.pos", "w.h1", "w.h2"))


def _place(docs: DataFrame) -> Column:
    """What orders places by id, then position: one number for integer ids, so that minima are hashed, not sorted."""
    if docs.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.col("id").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    return F.struct("id", "pos")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, gone): for each document that loses lines, the set of their positions (from 0). th is its text's hash.

    A window is removed wherever it occurs but at its first place by (id, position). Rows with a null id have no place
    and lose nothing; rows that repeat id and text share their places, and rows that share an id but not the text are
    documents of their own, of which equal windows at one position count as one place.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    rows = cut(_window_rows(docs, window))
    place = _place(docs)
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = rows.join(small(cut(first), width=48), ["h1", "h2"]).where(place != F.col("first"))
    return (later.select("id", "th", F.explode(F.sequence(F.col("pos"), F.col("pos") + (window - 1))).alias("line"))
            .groupBy("id", "th").agg(F.collect_set("line").alias("gone")))


def _rewritten(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, Column, Column]:
    """docs with private columns, the text of the lines that stay, and how many don't."""
    names = [fresh(docs, c) for c in ("gone_id", "gone_hash", "gone_lines")]
    gone = cut(repeated_lines(docs, id_col, text_col, window).toDF(*names))
    # an entry takes a line's number, or a document's id, hash and header
    gone = small(gone, weight=F.size(names[2]) + 8, width=8)
    match = (F.col(id_col) == F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    both = docs.join(gone, match, "left")
    none, lines = F.col(names[2]).isNull(), fresh(both, "all_lines")
    # behind explode a text is split once; a split that stands inside the lambda would be made again for every line
    both = both.withColumn(lines, F.explode(F.array(F.when(~none, F.split(F.col(text_col), "\n")))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(names[2]))
    text = F.when(none, F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return both, text, F.when(none, F.lit(0)).otherwise(F.size(names[2])).cast("long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with text_col rewritten, plus n_lines and n_removed (clashing columns are replaced).

    A line ends at \\n. Texts with fewer lines than the window stay as they are; a text whose lines all repeat becomes
    empty; null stays null with no lines. Blank lines count as lines, but a window of blank lines only isn't one. Of
    equal windows the one with the least (id, position) stays. Every row of docs comes back once; no rows: no rows.
    """
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text_col), "\n"))).cast("long")
    both, text, lost = _rewritten(docs, id_col, text_col, window)
    return both.select(*[F.col(c) for c in docs.columns if c not in (text_col, "n_lines", "n_removed")], text.alias(text_col), n_lines.alias("n_lines"), lost.alias("n_removed"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with text_col (and n_chars, if there is one) rewritten; documents that lose all their lines go.

    Null texts, empty ones and those that lose nothing stay as they are, with their n_chars; what is removed is what
    dedup_lines() removes. All columns stay, whatever their names. No rows: no rows.
    """
    both, text, lost = _rewritten(docs, id_col, text_col, window)
    kept, made = fresh(both, "kept_text"), fresh(both, "lost_lines")
    both = both.select(*docs.columns, text.alias(kept), lost.alias(made)).where((F.col(made) == 0) | (F.col(kept) != ""))
    new = {text_col: F.col(kept), "n_chars": F.when(F.col(made) == 0, F.col("n_chars")).otherwise(F.char_length(kept)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op10(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, line AS l0,
    lead(line, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS l1, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS l2
  FROM lines),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS k
  FROM windows WHERE l2 IS NOT NULL AND NOT (trim(l0, ' ') = '' AND trim(l1, ' ') = '' AND trim(l2, ' ') = '')),
gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (VALUES (0), (1), (2)) AS v(d) WHERE k > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id),
counts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""
