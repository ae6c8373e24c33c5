import gzip

from lexmill.operators import vocabulary as V
from lexmill.sources import readers, writers


def test_lines_and_tsv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one two \n\nthree four\n")
    rows = {r["name"]: r["text"] for r in readers.read_lines(spark, str(tmp_path / "a.txt")).collect()}
    assert rows == {"doc_0": "one two", "doc_2": "three four"}
    named = {r["name"]: r["text"] for r in readers.read_lines(spark, str(tmp_path / "a.txt"), id_field=True).collect()}
    assert named == {"one": "two", "three": "four"}
    (tmp_path / "b.tsv").write_text('1\tx\t"quoted text\nshort\n2\ty\tmore\n')
    got = [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "b.tsv")).orderBy("name").collect()]
    assert got == [("1", "x", '"quoted text'), ("2", "y", "more")]
    assert readers.short_rows(spark, str(tmp_path / "b.tsv"), 2) == 1


def test_corpus_round_trip(spark, tmp_path):
    d = V.corpus(readers.from_texts(spark, ["Hello there world", "", None, "more words"]))
    writers.save_corpus(d, str(tmp_path / "c"), {"min_df": 1})
    again, settings = writers.load_corpus(spark, str(tmp_path / "c"))
    assert settings == {"min_df": 1} and again.count() == 2
    assert writers.fingerprint(again, "doc_id", "tokens") == writers.fingerprint(d, "doc_id", "tokens")
    record = writers.manifest(spark, {"k": 2}, d, str(tmp_path / "m"))
    assert record["settings"] == {"k": 2} and writers.verify(spark, str(tmp_path / "m"), d)
    assert not writers.verify(spark, str(tmp_path / "m"), d.limit(1))


def test_topic_files(spark, tmp_path):
    phi = spark.createDataFrame([(0, "a", 0.75), (0, "b", 0.25)], "topic int, word string, p double")
    writers.write_topic_words(phi, str(tmp_path / "p"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["0\ta\t0.75", "0\tb\t0.25"]
    theta = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], "doc_id long, topic int, p double")
    writers.write_doc_topics(theta, str(tmp_path / "t"), [0, 1])
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "1\t0.5\t0.5"


def test_checksums(spark, tmp_path):
    with gzip.open(tmp_path / "x.gz", "wb") as f:
        f.write(b"abc")
    assert len(readers.checksums(spark, str(tmp_path / "x.gz")).first()["sha256"]) == 64
