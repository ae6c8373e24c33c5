"""Packing, SentencePiece, rollups, language ID, chat formatting and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import chat, langid, packing, pieces, rollups

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a   b", " \n \n x", "x  ", "a <|endoftext|> b", "it's 'll\t \tz", "é́ ñ 12 3\x1f \x85 q", "日本語 😂🧿", "x▁y", "\n\n a"]
EXTRA = "doc_id long, text string, start int, ids string, lang string, source string"


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, 1, "x", langs[i] if langs else "en", "s") for i, t in enumerate(texts)], EXTRA).repartition(2)


def prose(seed, n, words=None):
    rng = random.Random(seed)
    words = words or ["the", "river", "runs", "over", "old", "stones", "and", "sings", "unbelievably"]
    return " ".join(rng.choices(words, k=n))


def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    texts = ODD + [prose(i, random.Random(i).randint(1, 900)) for i in range(60)] + [prose(99, 15000)]
    rows = packing.pack(frame(spark, texts), BPE, shard_tokens=20_000).collect()
    tok = Tokenizer.from_file(BPE)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(want)
    for i, ids in want.items():
        got = []
        for r in sorted(by[i], key=lambda r: r["start"]):
            own = np.frombuffer(r["ids"], "<u4").tolist()
            assert r["start"] == len(got) and r["length"] == len(own) and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            got += own
        assert got == ids
    total = 0
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0  # nothing to pad
        total += at
    assert total == sum(map(len, want.values()))
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_packing_prefers_related_documents():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(100 * (i % 4), 100 * (i % 4) + 90, 700), 1).astype(np.uint16) for i in range(40)]
    seqs = {}
    for d, _, n, s, _ in packing.pack_shard(docs):
        seqs.setdefault(s, []).append((d % 4, n))
    mixed = sum(len({t for t, _ in parts}) for parts in seqs.values()) / len(seqs)
    assert mixed < 1.6  # random order would mix about three of the four topics


def test_packing_does_not_depend_on_the_layout(spark):
    topics = [[f"{w}{k}" for w in ("river", "stone", "song", "field", "lamp", "tower")] for k in range(4)]
    docs = [(i, prose(i, 150, topics[i % 4])) for i in range(120)]
    windows = []
    for rows, parts in ((docs, 1), (docs[::-1], 1), (docs, 7)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        windows.append({(r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"]) for r in packing.pack(df, BPE, shard_tokens=20_000).collect()})
    assert windows[0] == windows[1] == windows[2]
    seqs = {}
    for s, _, d, _, _ in windows[0]:
        seqs.setdefault(s, set()).add(d % 4)
    assert sum(map(len, seqs.values())) / len(seqs) < 1.5  # neighbours are found across the partitions read
    one, other = ([np.array([t, 1], np.uint16) for t in x] for x in ([5, 5, 6], [5, 6, 6]))
    whole = packing.Stats.of(one + other)
    assert whole.df[5] == 3 and packing.Bm25(one, whole).scores(0)[0] != packing.Bm25(one).scores(0)[0]
    assert len(packing.Bm25(other, whole).scores(0)) == 3


def brute_pack(docs, window):
    """Whole windows as lists of (document, start, length); plain BM25 and a greedy fill."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    tfs = [{t: d.count(t) for t in set(d)} for d in docs]
    df = {}
    for tf in tfs:
        for t in tf:
            df[t] = df.get(t, 0) + 1

    def score(a, b):
        return sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tfs[b][t] * 2.2 / (tfs[b][t] + 1.2 * (0.25 + 0.75 * len(docs[b]) / mean)) for t in tfs[a] if t in tfs[b])

    unused, windows, now, room, opener = list(range(n)), [], [], window, None
    while unused:
        d = unused[0] if room == window else max(unused, key=lambda b: (round(score(opener, b), 9), -b))
        unused.remove(d)
        start = 0
        while start < len(docs[d]):
            if room == window:
                opener = d
            take = min(room, len(docs[d]) - start)
            now.append((d, start, take))
            start, room = start + take, room - take
            if not room:
                windows.append(now)
                now, room = [], window
    return windows


def test_packing_matches_a_plain_greedy_fill():
    rng = random.Random(8)
    docs = [[rng.randrange(60) for _ in range(rng.choice([1, 3, 20, 60, 300]))] + [1] for _ in range(80)]
    docs += [docs[3], docs[3], [1]]
    want = brute_pack(docs, 64)
    got = {}
    for d, start, n, seq, at in sorted(packing.pack_shard([np.array(d, np.uint16) for d in docs], 64), key=lambda p: (p[3], p[4])):
        got.setdefault(seq, []).append((d, start, n))
    assert [got[i] for i in range(len(want))] == want and len(want) > 20
    assert sum(n for s in list(got)[len(want):] for _, _, n in got[s]) < 64


def test_packing_with_a_large_vocabulary_and_odd_rows(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w2"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.save(str(tmp_path / "words.json"))
    texts = [" ".join(f"w{j}" for j in (69_999 - i, 4463, 65_536 + i)) for i in range(5)]
    rows = [(None, texts[0]), (None, texts[0]), (1, texts[1]), (1, texts[1]), (2, None), (3, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, str(tmp_path / "words.json")).collect()
    want = sorted(([69_999 - i, 4463, 65_536 + i, 1] for i in (0, 0, 1, 1, 2)), key=str) + [[1]]
    whole = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        whole.setdefault((r["doc_id"], r["start"]), []).append(np.frombuffer(r["ids"], "<u4").tolist())
    flat = sorted(x for r in got for x in np.frombuffer(r["ids"], "<u4").tolist())
    assert flat == sorted(x for w in want for x in w)
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 8 and sum(r["length"] for r in got if r["doc_id"] == 1) == 8


def test_packing_scores_all_terms_of_a_seed():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 150, rng.integers(1, 200)).astype(np.uint16) for _ in range(30)] + [np.arange(60, dtype=np.uint16)]
    index, stats = packing.Bm25(docs), packing.Stats.of(docs)
    for seed, q in enumerate(docs):
        want = [sum(stats.idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / stats.mean)) for t in set(q.tolist()) if (tf := int((d == t).sum()))) for d in docs]
        assert np.allclose(index.scores(seed), want)


def brute_pieces(p, text):
    if not text:
        return []
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for k in range(min(p.longest, j), 0, -1):
            x = s[j - k : j]
            if x in p.plain:
                c, ids = best[j - k] + p.plain[x][1], [p.plain[x][0]]
            elif k == 1:
                c, ids = best[j - 1] + p.unknown, [p.bytes[b] for b in x.encode()]
            else:
                continue
            if c > best[j]:
                best[j], back[j] = c, (k, ids)
    out, j = [], len(s)
    while j:
        k, ids = back[j]
        out, j = ids + out, j - k
    return out


def test_sentencepiece_ids_are_those_of_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    made = [" ".join("".join(rng.choices("aeinorstlhdé", k=rng.randint(1, 14))) for _ in range(60)) for _ in range(10)]
    texts = [t for t in ODD if t and pieces.MARK not in t] + made + [prose(i, 60) for i in range(5)] + ["aaaa" * 60, "the  unbelievable   Straßenbahn 12:30"]
    rows = pieces.encode(frame(spark, texts), PIECES).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: model.encode(t) for i, t in enumerate(texts)}
    assert any(pieces.Pieces(PIECES).encode([t])[0].tolist() != model.encode(t) for t in made)  # the best path isn't the model's


def test_sentencepiece_is_the_best_path_and_round_trips(spark):
    p = pieces.Pieces(PIECES)
    texts = ODD + [prose(i, 60) for i in range(20)] + ["aaaa" * 60, prose(5, 5000), "a\U0010fffeb ▁ \U0010ffff▁", "▁"]
    for t, ids in zip(texts, p.encode(texts), strict=True):
        assert p.decode(ids) == (t or "")
        if t and pieces.MARK not in t and len(t) < 3000:
            assert ids.tolist() == brute_pieces(p, t)
    enc = pieces.encode(frame(spark, texts), PIECES)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(enc, PIECES).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    dig = {r["doc_id"]: r for r in pieces.digest(frame(spark, texts), PIECES).collect()}
    assert all(r["round_trip"] for r in dig.values())
    assert {r["doc_id"]: r["ids_crc32"] for r in enc.collect()} == {i: r["ids_crc32"] for i, r in dig.items()}
    assert pieces.digest(frame(spark, []), PIECES).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "x▁"), (1, "x▁")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["n_tokens"]) for r in pieces.digest(odd, PIECES).collect()), key=str)
    assert len(got) == 5 and [x for x in got if x[0]] == [(True, 2)] * 2 and (False, 0) in got


def test_sentencepiece_compares_letters_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(pieces, "_BASE", np.uint64(1))  # hashes of anagrams collide
    p, true = pieces.Pieces(PIECES), ["the", "eth", "het", "stop pots tops", "unbelievable"]
    assert [p.decode(x) for x in p.encode(true)] == true
    assert all(x.tolist() == brute_pieces(p, t) for x, t in zip(p.encode(true), true, strict=True))


def test_sentencepiece_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 10)
    p = pieces.Pieces(PIECES)
    for i in range(5):
        t = [prose(i, 50, [f"w{j}" for j in range(40)])]
        assert p.decode(p.encode(t)[0]) == t[0]


def rollup_of(df):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in df.collect()}


COUNTS = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"


def test_rollup_is_signed_and_idempotent(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, "de", "v1", None)], COUNTS)
    r = rollups.Rollup(spark, str(tmp_path))
    assert r.totals().count() == 0 and not r.compact()
    assert r.apply("b/1", rollups.inserts(d)) and not r.apply("b/1", rollups.inserts(d))
    want = {("a", "en", "v1"): (2, 15), (None, "de", "v1"): (1, 0)}
    assert rollup_of(r.totals()) == want
    assert not r._publish(f"live/{r._file('b/1')}", {}) and rollup_of(r.totals()) == want  # two writers at a time
    assert r.apply("b2", rollups.deletes(d.where("doc_id = 2")))
    assert r.apply("b3", rollups.revisions(d.where("doc_id = 1").withColumn("old_tokens", F.col("n_tokens")).withColumn("n_tokens", F.lit(12))))
    want[("a", "en", "v1")] = (1, 12)
    assert rollup_of(r.totals()) == want
    assert r.compact() and rollup_of(r.totals()) == want and r._names("live") == [] and not r.compact()
    assert not r.apply("b2", rollups.deletes(d))  # still known after compaction
    assert r.apply("b4", rollups.deletes(d.where("doc_id = 3"))) and set(rollup_of(r.totals())) == {("a", "en", "v1")}
    assert r.compact() and set(rollup_of(rollups.Rollup(spark, str(tmp_path)).totals())) == {("a", "en", "v1")}
    assert r.apply("empty", rollups.inserts(d.limit(0))) and set(rollup_of(r.totals())) == {("a", "en", "v1")}


def test_rollup_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(1, "a", "en", "v1", 10)], COUNTS)
    r = rollups.Rollup(spark, str(tmp_path))
    dumps = rollups.json.dumps

    def dies(content):
        raise KeyboardInterrupt

    monkeypatch.setattr(rollups.json, "dumps", dies)  # after the commit's file has been created
    with pytest.raises(KeyboardInterrupt):
        r.apply("b1", rollups.inserts(d))
    monkeypatch.setattr(rollups.json, "dumps", dumps)
    assert rollup_of(r.totals()) == {} and r.apply("b1", rollups.inserts(d))
    assert rollup_of(r.totals()) == {("a", "en", "v1"): (1, 10)}
    # a compaction dies before it has moved the commit files: the next one does
    monkeypatch.setattr(rollups.Rollup, "_tidy", lambda self, number: None)
    assert r.compact()
    assert rollup_of(r.totals()) == {("a", "en", "v1"): (1, 10)} and not r.apply("b1", rollups.inserts(d))
    monkeypatch.undo()
    assert r.apply("b2", rollups.inserts(d)) and r.compact() and r._names("live") == []
    assert rollup_of(r.totals()) == {("a", "en", "v1"): (2, 20)}


def test_rollup_batches_and_compactions_that_race(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(1, "a", "en", "v1", 10)], COUNTS)
    r, other = rollups.Rollup(spark, str(tmp_path)), rollups.Rollup(spark, str(tmp_path))
    r.apply("b1", rollups.inserts(d))
    stored = r._stored

    def late(paths):
        monkeypatch.undo()
        assert other.apply("b2", rollups.inserts(d))  # committed while the compaction sums
        return stored(paths)

    monkeypatch.setattr(r, "_stored", late)
    assert r.compact() and rollup_of(r.totals()) == {("a", "en", "v1"): (2, 20)}

    def second(paths):
        monkeypatch.undo()
        assert other.compact()  # takes the generation first
        return stored(paths)

    monkeypatch.setattr(r, "_stored", second)
    assert not r.compact() and rollup_of(r.totals()) == {("a", "en", "v1"): (2, 20)}
    # another writer's batch is committed, folded and moved while this one writes
    sums = r._sums

    def slow(df):
        monkeypatch.undo()
        assert other.apply("b3", rollups.inserts(d)) and other.compact()
        return sums(df)

    monkeypatch.setattr(r, "_sums", slow)
    assert not r.apply("b3", rollups.inserts(d)) and rollup_of(r.totals()) == {("a", "en", "v1"): (3, 30)}


def test_token_counts_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ODD + [prose(1, 30)]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(1, 1), (12, 1), (12, 1), (99, 1), (3, 0)], "doc_id long, toxic int")
    got = rollups.op9(df, labels)
    for state, gone in (("all", ()), ("clean", (1, 12))):
        left = [t for i, t in enumerate(texts) if i not in gone]
        assert rollup_of(got.where(F.col("state") == state)) == {("s", "en", "byte_bpe_50k"): (len(left), sum(len(tok.encode(t or "", add_special_tokens=False).ids) for t in left))}


LANG = {"en": ["the", "and", "with", "shore", "thing", "when"], "de": ["der", "und", "schön", "straße", "nicht", "wenn"], "fr": ["le", "être", "avec", "forêt", "où", "quand"]}


@pytest.fixture(scope="module")
def tongues(spark):
    texts, langs = [], []
    for i in range(240):
        lang = list(LANG)[i % 3]
        texts.append(prose(i, 20, LANG[lang]))
        langs.append(lang)
    return texts, langs


def test_language_id(spark, tongues):
    texts, langs = tongues
    odd = [None, "", "123 !?", "the and with thing " * 5 + "und nicht wenn schön straße der " * 30, prose(3, 25000, LANG["fr"])]
    df = frame(spark, texts + odd, langs + ["en", "en", "en", "de", None])
    rows = {r["doc_id"]: r for r in langid.op4(df).collect()}
    assert len(rows) == 245
    held = [i for i in range(240) if rows[i]["held_out"]]
    assert held == [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(rows[i]["lang_pred"] == langs[i] for i in held) == len(held)
    assert [rows[240 + i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[243]["score"] < 0.95
    left = langid.reject_unknown(df)
    assert left.columns == df.columns and left.count() == 242
    none = langid.op4(frame(spark, [None, "words"], [None, None]).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.op4(df.limit(0)).count() == 0


def test_words_are_letters_and_their_marks():
    assert langid.words("½ ² 12 Ⅷ _ नमस्ते Été's x2y") == ["नमस्ते", "été", "s", "x", "y"]
    assert langid.words("\U00010400a 🧿") == ["\U00010428a"] and langid.words(None) == langid.words("") == []


def test_language_of_texts_without_letters_and_clashing_names(spark, tongues):
    texts, langs = tongues
    df = frame(spark, [*texts, "½ ² 12 Ⅷ", texts[0], texts[0]], [*langs, "en", langs[0], langs[0]])
    rows = {r["doc_id"]: r for r in langid.op4(df).collect()}
    assert (rows[240]["lang_pred"], rows[240]["score"]) == ("und", 0.0)
    own = df.withColumns({"lang_pred": F.lit("mine"), "LANG_SCORE": F.lit(2), "pred": F.lit(3), "found": F.lit(4), "score": F.lit(5)})
    left = langid.reject_unknown(own)
    assert left.columns == own.columns and left.where("lang_pred = 'mine' and LANG_SCORE = 2 and pred = 3 and found = 4 and score = 5").count() == left.count() == 242
    assert langid.reject_unknown(df.limit(0)).count() == 0


def plain_posteriors(crf, text):
    """One document's words by a forward-backward in logarithms, one state at a time."""
    ws = langid.words(text)
    e = [crf.emissions([w])[0] for w in ws]
    k, lse = len(crf.langs), np.logaddexp.reduce
    fwd = [crf.begin + e[0]]
    for x in e[1:]:
        fwd.append(np.array([lse(fwd[-1] + crf.trans[:, j]) + x[j] for j in range(k)]))
    bwd = [np.zeros(k)]
    for x in e[:0:-1]:
        bwd.append(np.array([lse(crf.trans[i] + x + bwd[-1]) for i in range(k)]))
    out = np.array(fwd) + np.array(bwd[::-1])
    return np.exp(out - lse(out, axis=1, keepdims=True)), ws


def test_predictions_match_a_plain_field(tongues, monkeypatch):
    texts, langs = tongues
    crf = langid.train(list(zip(texts[:120], langs[:120], strict=True)))
    mixed = [*texts[120:150], "the and with und nicht le forêt être", " ".join(texts[120:140]), "zzz", None, "12"]
    plain = [plain_posteriors(crf, t) if langid.words(t) else None for t in mixed]
    for cells in (1_000_000, 30):  # held whole, and walked in blocks
        monkeypatch.setattr(langid, "CELLS", cells)
        pred, score = langid.Labeller(crf).languages(mixed)
        spans = langid.Labeller(crf).spans(mixed)
        for i, p in enumerate(plain):
            if p is None:
                assert (pred[i], score[i], spans[i]) == ("und", 0.0, [])
                continue
            mass = np.array([len(w) for w in p[1]]) @ p[0]
            assert pred[i] == crf.langs[mass.argmax()] and abs(score[i] - mass.max() / mass.sum()) < 1e-5
            best = [crf.langs[x] for x in p[0].argmax(axis=1)]
            assert [x for a, b, x in spans[i] for _ in langid.words(mixed[i].lower()[a:b])] == best


def test_every_language_is_learned_and_switches_are_found(spark):
    made = {f"l{k:02d}": [f"{c}{x}{'aeiou'[k % 5]}{k}".translate(str.maketrans("0123456789", "bcdfghjklm")) for c in "ptkrs" for x in "aou"] for k in range(25)}
    rows = [(i, prose(i, 30, made[f"l{i % 25:02d}"]), f"l{i % 25:02d}") for i in range(500)] + [(900, prose(1, 20_000, ["vyx", "xyv", "yvvy"]), "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = langid.fit(df)
    assert set(crf.langs) == {*made, "only"}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.label(df.where("doc_id < 500"), crf).collect()}
    assert sum(got[i] == f"l{i % 25:02d}" for i in range(500)) > 490
    text = prose(1, 15, made["l03"]) + " " + prose(2, 15, made["l07"])
    runs = langid.language_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), crf).orderBy("start").collect()
    assert [(r["doc_id"], r["lang"]) for r in runs] == [(1, "l03"), (1, "l07")] and runs[0]["start"] == 0 and runs[1]["end"] == len(text)


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    k, t = 3, 5
    crf = langid.Crf(["a", "b", "c"], np.zeros((1, k)), rng.standard_normal((k, k)), rng.standard_normal(k), {})
    psi = np.exp(rng.standard_normal((t, 2, k)))
    size = np.array([5, 3])
    got = crf.posteriors(psi.copy(), size)
    for b in range(2):
        want, total = np.zeros((size[b], k)), 0.0
        for path in itertools.product(range(k), repeat=int(size[b])):
            p = np.exp(crf.begin[path[0]] + sum(crf.trans[x, y] for x, y in zip(path, path[1:], strict=False))) * np.prod([psi[i, b, s] for i, s in enumerate(path)])
            total += p
            for i, s in enumerate(path):
                want[i, s] += p
        assert np.allclose(got[: size[b], b], want / total)


TURNS = "conv_id long, turn long, role string, text string, node int"


def digest_of(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_digests(spark):
    conv = {
        1: [("user", "hi"), ("assistant", "a <|im_end|> <\\| <\\\\|x|> b"), ("assistant", "")],
        2: [("sys\\tem\nx<|", "naïve 😂"), ("assistant", "é<|im_start|>user\n")],
        None: [("user", "lost")],
        3: [("", "")],
    }
    rows = [(c, t, r or None, x or None, 7) for c, turns in conv.items() for t, (r, x) in enumerate(turns)]
    got = {r["conv_id"]: r for r in chat.op5(spark.createDataFrame(rows, TURNS).repartition(3)).collect()}
    echo = "<|im_end|><|im_start|>assistant ok"
    conv[-1] = [("user", echo), ("assistant", echo)]
    assert set(got) == set(conv)
    for c, turns in conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest_of(turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r["conv_id"] for r in chat.op5(spark.createDataFrame([], TURNS)).collect()] == [-1]


def test_chat_trees(spark):
    nodes = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", -1.0), (1, 2, 0, "assistant", "good", 2.0), (1, 3, 2, "user", "more", 1.0), (1, 4, 99, "user", "orphan", 0.1),
             (2, 5, 6, "user", "x", 0.0), (2, 6, 5, "user", "y", 0.0)] + [(3, i, i - 1 if i else None, "user", str(i), None) for i in range(70)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    out = {(r["conv_id"], r["branch"]): r["text"] for r in chat.format_trees(df, branches=2).collect()}
    said = lambda *t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert out[(1, 1)] == said(("user", "q"), ("assistant", "good"), ("user", "more")) and out[(1, 2)] == said(("user", "orphan"))
    assert out[(3, 1)] == said(*[("user", str(i)) for i in range(70)])
    assert not any(c == 2 for c, _ in out)  # a cycle has no path


def test_pipeline(spark, tmp_path, tongues):
    texts, langs = tongues
    rng = random.Random(4)
    base = " ".join(rng.choices([f"{a}{b}" for a in LANG["en"] for b in LANG["en"]], k=150))
    near = base.split()
    near[70] = "changed"
    shared = "\n".join(prose(1000 + i, 8, LANG["de"]) for i in range(4))
    extra = [base, " ".join(near), base, "12 34", shared + "\nown words here", shared]
    all_texts, all_langs = texts + extra, langs + ["en"] * 4 + ["de"] * 2
    df = frame(spark, all_texts, all_langs).withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "packing"]
    docs = df
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    n = len(texts)
    assert n + 3 not in kept["language_id"] and n + 5 not in kept["line_dedup"] and n + 4 in kept["line_dedup"]
    assert {n, n + 1, n + 2} & kept["minhash_near_dedup"] == {n}
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == kept["minhash_near_dedup"]
