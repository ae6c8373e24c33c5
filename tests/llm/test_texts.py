"""Near-duplicate texts, line dedup and license scans against plain Python."""

import random
import re

from pyspark.sql import functions as F

from lexmill.llm import licenses, line_dedup, near_dup_text

SCHEMA = "doc_id long, text string, component_id int, w string, kept boolean"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 0, "x", True) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(texts, percent):
    sets, comp = [shingle_set(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in range(len(texts)):
        before = list(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    return [len(s) for s in sets], comp


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Straße"]
    out = [None, "", " \t\n", "one two", "One  TWO", "one two three four five"]
    for _ in range(30):
        out.append(" ".join(rng.choices(vocab, k=rng.randint(3, 200))))
    for _ in range(120):  # edits of all strengths, so many pairs lie near the threshold
        w = rng.choice(out[6:36]).split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [out[10]] * 40 + [" ".join(rng.choices(vocab, k=9000))]
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = corpus()
    n, comp = brute(texts, 85)
    got = {r["doc_id"]: r for r in near_dup_text.near_duplicates(frame(spark, texts), percent=85).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(len(texts)))


def test_one_large_torn_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup_text, "BLOCK", 16)
    rng = random.Random(1)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(150):  # copies of one text whose pairs lie on both sides of the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    _, comp = brute(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dup_text.near_duplicates(frame(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_near_duplicates_odd_ids(spark):
    t = "a b c d e f g h"
    rows = near_dup_text.near_duplicates(frame(spark, [t, t, t, None], [None, 7, 7, None])).collect()
    assert len(rows) == 4 and {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(None, 7, False), (7, 7, True), (None, None, True)}
    assert near_dup_text.near_duplicates(frame(spark, [])).count() == 0
    kept = near_dup_text.keep_one(frame(spark, [t, t, "other words here"]))
    assert kept.columns == ["doc_id", "text", "component_id", "w", "kept"] and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_rows_that_share_an_id_are_compared_by_their_own_texts(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    texts, ids = [a, b, near(a), near(b), c, c, c, None, None, ""], [5, 5, 7, 8, 9, 9, None, 9, 9, 9]
    df = frame(spark, texts, ids)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup_text.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 76, 5), (5, 76, 5), (7, 76, 5), (8, 76, 5), (9, 76, 9), (9, 76, 9), (None, 76, 9), (9, 0, 9), (9, 0, 9), (9, 0, 9)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dup_text.keep_one(df).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (9, c), (9, None), (9, None), (9, "")], key=str)
    clash = df.withColumns({x: F.lit(1) for x in ("gone_id", "gone_hash", "touched_id", "touched_hash", "best", "id", "th", "node", "__gone")})
    out = near_dup_text.keep_one(clash)
    assert out.columns == clash.columns and out.count() == 6


def test_a_large_linked_group_with_strays(spark, monkeypatch):
    monkeypatch.setattr(near_dup_text, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"v{i}" for i in range(200)]
    texts = []
    for i in range(120):  # all near the base
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    for k in range(6):  # strays that share bands with the group, some of them linked with a few members only
        w = texts[k].split()
        for _ in range(2 + k):
            w[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    _, comp = brute(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dup_text.near_duplicates(frame(spark, texts), percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == comp
    apart = spark.createDataFrame([(1, i, 0 if i < 5000 else i) for i in range(5010)], "key long, node long, comp long")
    assert near_dup_text._blocked(apart).count() < 4 * 5010  # linear in the members


def brute_lines(texts):
    seen, gone = {}, {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n") if t is not None else []
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if seen.setdefault(w, (i, p)) != (i, p):
                gone.setdefault(i, set()).update((p, p + 1, p + 2))
    out = []
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone.get(i, ())), len(lines), len(gone.get(i, ()))))
    return out


def test_line_dedup_matches_plain_version(spark):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(12)] + ["", " "]
    texts = [None, "", "a", "a\nb\nc", "a\nb\nc", "\n\n\n\n", "\n\n\n\n"] + ["\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(80)] + ["same\n" * 500]
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(frame(spark, texts)).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == brute_lines(texts)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_keeps_columns_and_odd_ids(spark):
    df = frame(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc", "x\na\nb\nc"], [None, 1, 2, 3])
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(df.withColumn("n_lines", F.lit("clash"))).collect()}
    assert rows[None]["text"] == rows[1]["text"] == "a\nb\nc" and rows[2]["text"] == "" and rows[3]["text"] == "x"
    left = line_dedup.drop_repeats(df.withColumn("n_chars", F.length("text")))
    assert {r["doc_id"]: r["n_chars"] for r in left.collect()} == {None: 5, 1: 5, 3: 1}
    twice = line_dedup.dedup_lines(df.where("doc_id = 1").unionAll(df.where("doc_id = 1")))
    assert [r["n_removed"] for r in twice.collect()] == [0, 0]


def test_license_scan(spark):
    mit = licenses.NOTICES[0][0]
    worn = " ".join(w for i, w in enumerate(mit.split()) if i != 9)  # one word lost in the middle
    texts = [None, "", "no terms", "GNU general-public LICENSE; gnu general public license", "the MIT license, Apache License and cc-by", mit.upper(), worn, "gnu general public", "mit mit license license", mit + " " + worn, "x " * 20000 + "mit license"]
    got = {r["doc_id"]: r for r in licenses.license_report(frame(spark, texts)).collect()}
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    for i, w in enumerate(split):
        at = [(p, label) for text, label in licenses.PHRASES for p in range(len(w)) if w[p : p + len(text.split())] == text.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
    assert [got[i]["labels"] for i in (3, 4, 5, 6, 7)] == ["gpl", "apache,cc-by,mit", "mit", "mit", ""]
    assert got[5]["score"] == 1.0 and 0.8 <= got[6]["score"] < 1 and got[7]["score"] == 0.0
    twice = frame(spark, ["mit license", "mit license", "mit license"], [1, 1, None])
    assert {(r["doc_id"], r["n_base"]) for r in licenses.license_report(twice).collect()} == {(1, 1), (None, 1)}
    assert licenses.license_report(frame(spark, [])).count() == 0
    # only A-Z are lower-cased: the Kelvin sign is a letter of its own
    assert [r["labels"] for r in licenses.license_report(frame(spark, [mit.replace("k", "\u212a"), "M\u0130T license"])).orderBy("doc_id").collect()] == ["mit", ""]


def test_license_templates_of_any_length(spark):
    rng = random.Random(2)
    words = [f"t{rng.randrange(500)}" for _ in range(200)]
    body = [*words[:90], "new", "words", *words[90:150], *words[152:]]
    scattered = [x for i in range(0, 200, 5) for x in (*words[i : i + 5], *(f"u{rng.randrange(10**6)}" for _ in range(20)))]  # in order, but far apart
    texts = [" ".join(x) for x in (words, ["a", *body, "z"], words[:100], scattered, words[100:] + words[:100], words + words)]
    got = {}
    for r in licenses.scan(frame(spark, texts), phrases=(), notices=((" ".join(words), "long"),)).collect():
        got.setdefault(r["id"], []).append((r["first"], r["last"], round(r["cover"], 2)))
    assert got[0] == [(0, 199, 1.0)] and set(got) == {0, 1, 5}
    assert got[1][0][0] in (0, 1) and 190 < got[1][0][1] < 205 and 0.9 < got[1][0][2] < 1
    assert sorted(got[5]) == [(0, 199, 1.0), (200, 399, 1.0)]
