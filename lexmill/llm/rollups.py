"""Delta-maintained token counts.

Changes are signed: an insert adds its tokens, a delete takes them away, a revision adds the new count and takes the
old one away. A batch of changes is summed by source, language and tokenizer version, written to the shared folder and
committed by publishing one whole file that names the batch. That file can be published once only, so a batch that is
sent again, or by two writers at a time, counts once, and a writer that dies earlier leaves nothing that counts.

Totals are the latest generation's sums and those of the batches committed since. A compaction sums exactly the batches
it has listed, names them in the next generation's file, of which only one can be published, and then moves their commit
files from `live` to `done`; the next compaction finishes such moves. A reader that sees a new generation after listing
lists again. So lists stay as short as the batches since the last compaction, however many there have been.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, small, tuned
from .packing import ByteBpe

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Bytes of text that a token is taken to have until it is counted.
PROVISIONAL = 4


class Rollup:
    """Totals of one folder of a Hadoop file system. Batches not yet committed are never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = lambda x: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{x}")
        self._fs = self._path("live").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("live", "done", "generations", "writing"):
            self._fs.mkdirs(self._path(folder))

    @staticmethod
    def _file(batch: str) -> str:
        """A file name for any batch name."""
        return f"b-{urllib.parse.quote(batch, safe='')}.json"

    def _publish(self, name: str, content: dict) -> bool:
        """Makes a whole file appear under a name; False if that name is taken."""
        held = self._path(f"writing/{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a local rename overwrites, a link doesn't
                nio = self._jvm.java.nio.file
                local = lambda p: nio.Paths.get(self._fs.makeQualified(p).toUri())
                nio.Files.createLink(local(self._path(name)), local(held))
            else:
                opts = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(held, self._path(name), opts)
            return True
        except Py4JJavaError:
            if self._fs.exists(self._path(name)):
                return False
            raise
        finally:
            self._fs.delete(held, False)

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if not s.getPath().getName().startswith("."))

    def _read(self, files: list[str]) -> list[dict]:
        return [json.loads(r["value"]) for r in self.spark.read.text([f"{self.root}/{f}" for f in files], wholetext=True).collect()] if files else []

    def _generation(self) -> tuple[int, dict]:
        numbers = self._names("generations")  # zero-padded numbers
        return (int(numbers[-1].split(".")[0]), self._read([f"generations/{numbers[-1]}"])[0]) if numbers else (0, {"data": None, "batches": []})

    def _state(self) -> tuple[int, list[str], list[str]]:
        """The generation, the commit files since, and the folders whose sum is the totals, as of one moment."""
        while True:
            number, last = self._generation()
            folded = set(last["batches"])
            live = [f for f in self._names("live") if f not in folded and not self._fs.exists(self._path(f"done/{f}"))]
            if not self._fs.exists(self._path(f"generations/{number + 1:012d}.json")):  # else files may have moved meanwhile
                break
        data = [c["data"] for c in self._read([f"live/{f}" for f in live])]
        return number, live, ([last["data"]] if last["data"] else []) + data

    def committed(self, batch: str) -> bool:
        return any(self._fs.exists(self._path(f"{folder}/{self._file(batch)}")) for folder in ("live", "done"))

    def _sums(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def _stored(self, data: list[str]) -> DataFrame:
        df = self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{d}" for d in data]) if data else self.spark.createDataFrame([], SCHEMA)
        return self._sums(df).where("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Sums and commits the changes (source, lang, tokenizer_version, n_docs, n_tokens, signed); False if that batch is committed already."""
        if self.committed(batch):
            return False
        file, data = self._file(batch), f"data/{uuid.uuid4().hex}"
        self._sums(changes).write.parquet(f"{self.root}/{data}")
        if self._publish(f"live/{file}", {"batch": batch, "data": data}):
            if not self._fs.exists(self._path(f"done/{file}")):
                return True
            self._fs.delete(self._path(f"live/{file}"), False)  # another writer's, folded meanwhile; nobody counts this one
        self._fs.delete(self._path(data), True)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over committed batches; keys whose sums are 0 are gone."""
        return self._stored(self._state()[2])

    def _tidy(self, number: int) -> None:
        """Moves the commit files that a generation has taken in."""
        for file in self._read([f"generations/{number:012d}.json"])[0]["batches"] if number else []:
            at, to = self._path(f"live/{file}"), self._path(f"done/{file}")
            if self._fs.exists(at):
                self._fs.delete(at, False) if self._fs.exists(to) else self._fs.rename(at, to)

    def compact(self) -> bool:
        """Folds the batches committed since the last generation into a new one. False if there is nothing to fold or another compaction was first."""
        number, live, paths = self._state()
        self._tidy(number)  # before the next generation, which doesn't name these files any more
        if not live:
            return False
        data = f"data/{uuid.uuid4().hex}"
        self._stored(paths).write.parquet(f"{self.root}/{data}")
        if not self._publish(f"generations/{number + 1:012d}.json", {"data": data, "batches": live}):
            self._fs.delete(self._path(data), True)
            return False
        self._tidy(number + 1)
        return True


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))


def revisions(counts: DataFrame, old: str = "old_tokens") -> DataFrame:
    """Documents whose n_tokens replaces the count in column old."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.coalesce("n_tokens", F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("n_tokens"))


def _count(path: str):
    def run(batches):
        encode = ByteBpe(path)
        for batch in batches:
            n = np.array([len(encode(t.as_py())) for t in batch.column(3)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), batch.column(4)], ["doc_id", "source", "lang", "n_tokens", "n_bytes"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens, n_bytes), one row for each of docs; a null text has no tokens.

    Null sources and languages are keys of their own; repeated rows count each; no rows: no rows.
    """
    tuned(docs.sparkSession)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", "text", size).mapInArrow(_count(tokenizer_path), "doc_id long, source string, lang string, n_tokens long, n_bytes long")
    return rows.withColumn("tokenizer_version", F.lit(version))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals of all documents and of the clean ones: (state, source, lang, tokenizer_version, n_docs, n_tokens).

    All documents are inserted with a provisional count of a token to four bytes, which a revision replaces by the
    tokenizer's; that gives the state `all`. The insert is sent again, which must not count, the batches are folded into
    one, and the documents labelled toxic are deleted; that gives the state `clean`.
    """
    import public_tokenizers

    spark = docs.sparkSession
    root = scratch(spark, "rollup")
    token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k").write.parquet(f"{root}/counts")
    counts = spark.read.parquet(f"{root}/counts")
    guess = counts.withColumn("n_tokens", F.ceil(F.col("n_bytes") / PROVISIONAL))
    rollup = Rollup(spark, f"{root}/totals")
    rollup.apply("insert/0", inserts(guess))
    rollup.apply("revise/0", revisions(counts.withColumn("old_tokens", F.ceil(F.col("n_bytes") / PROVISIONAL))))
    whole = cut(rollup.totals())
    rollup.apply("insert/0", inserts(guess))
    rollup.compact()
    toxic = cut(labels.where("toxic = 1").select(F.col("doc_id").alias("bad")).distinct())
    rollup.apply("delete/0", deletes(counts.join(small(toxic), F.col("doc_id") == F.col("bad"), "left_semi")))
    states = [df.select(F.lit(name).alias("state"), *KEYS, *SUMS) for name, df in (("all", whole), ("clean", rollup.totals()))]
    return cut(states[0].unionByName(states[1]))
