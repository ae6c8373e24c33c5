"""Fill-in-middle, token files and the divergence audit against brute force, and bounds on work in long rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import chat, divergence, fim, langid, line_dedup, pieces, rans, token_files

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "a   b", " \n \n x", "x  ", "a <|endoftext|> b", "it's 'll\t \tz", "é́ ñ 12 3\x1f \x85 q", "日本語 😂🧿 abc", "< P> <P", "x<P>y", "<S>", "ab<M", "a<<S>>", "<P<S<M", "\n\n a", "A b  c", "q " * 700]
SCHEMA = "doc_id long, text string, n string, form int, key string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", la, so) for i, t, la, so in rows], SCHEMA).repartition(3)


def texts(n=60, seed=5):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = ["".join(rng.choices("abcdeéß<>PSM1. \n", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 400))]
        made.append(" ".join(words))
    return ODD + made


def plain_fim(doc_id, text):
    text = text or ""
    toks = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(toks)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(toks[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h[3] % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def order(rows):
    return sorted(rows, key=str)


def test_fim_equals_plain_version(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(texts())] + [(None, "null id here", "en", "s"), (3, "id again", "en", "s"), (3, "id again", "en", "s")]
    got = [tuple(r) for r in fim.op11(frame(spark, docs)).collect()]
    assert order(got) == order(plain_fim(i, t) for i, t, *_ in docs)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.op11(frame(spark, [])).count() == 0


def test_fim_of_giant_documents_is_the_same(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(texts(40))] + [(7, "giant row twice " * 90, "en", "s")] * 2 + [(None, "giant row of no id " * 90, "en", "s")]
    made = fim.transform(frame(spark, docs), giant=100, chunk=130)
    got = [(r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], hashlib.sha256(r["output"].encode()).hexdigest(), hashlib.sha256(r["restored"].encode()).hexdigest()) for r in made.collect()]
    assert order(got) == order(plain_fim(i, t) for i, t, *_ in docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab<>PSMé1 ", max_size=2000), max_size=6), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_automaton_scan(docs, h1, h2):
    auto = fim.fill_in_middle()
    n, marks, place = fim.scan(auto, docs, np.full(len(docs), h1), np.full(len(docs), h2)) if docs else ([], [], np.empty((2, 0)))
    for d, t in enumerate(docs):
        toks = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted((h1 % (len(toks) + 1), h2 % (len(toks) + 1)))
        assert (n[d], marks[d]) == (len(toks), len(re.findall("<[PSM]>", t)))
        assert place[:, d].tolist() == [len("".join(toks[:a])), len("".join(toks[:b]))]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    tok, encoder = Tokenizer.from_file(BPE), token_files.Encoder(BPE)
    rng = random.Random(3)
    made = texts(80) + ["".join(rng.choices(" \n\tab'sé.1 \x1c\x85", k=60)) for _ in range(300)]
    for _ in range(2):  # again, from the words that are known
        for t, ids in zip(made, encoder.encode(made), strict=True):
            assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=700), max_size=5), st.sampled_from([(4, 8), (32, 64), (8, 512)]))
def test_range_coding_round_trip(blocks, shape):
    blocks = [np.array(b, np.int64) for b in blocks]
    table = rans.Table.of(np.bincount(np.concatenate([*blocks, np.array([5])]), minlength=301))
    table = rans.Table.frombytes(table.tobytes())
    raw = rans.encode(blocks, table, *shape)
    for a, b in zip(blocks, rans.decode(raw, table), strict=True):
        assert a.tolist() == b.tolist()
    for a, b in zip(blocks, rans.decode(raw, table, 1, 3), strict=True):  # from a checkpoint
        assert a[shape[1] : 3 * shape[1]].tolist() == b.tolist()


def test_damaged_blocks_are_refused():
    ids = np.random.default_rng(0).zipf(1.5, 20_000) % 1000
    table = rans.Table.of(np.bincount(ids, minlength=1000))
    raw = rans.encode([ids], table)[0]
    assert len(raw) < 2.2 * len(ids)
    for bad in (raw[:-4], raw[:10], b"X" + raw[1:], raw[:-40] + bytes([raw[-40] ^ 1]) + raw[-39:]):
        with pytest.raises(ValueError):
            rans.decode([bad], table)
    with pytest.raises(ValueError):
        rans.decode([raw], rans.Table.of(np.bincount(ids, minlength=1001) + 1))
    with pytest.raises(ValueError):
        rans.encode([np.array([1_000_000])], table)


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK", 1 << 8)
    tok = Tokenizer.from_file(BPE)
    docs = [(i * 3 - 30, t, "en", "s") for i, t in enumerate(texts(40))] + [(None, "no id", "en", "s"), (9, "again", "en", "s"), (9, "again", "en", "s")]
    path = str(tmp_path / "files")
    token_files.write(frame(spark, docs), BPE, path, shard_ids=4000)
    assert spark.read.parquet(f"{path}/blocks").select("shard").distinct().count() > 3
    got = sorted((tuple(r) for r in token_files.digest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d[0] for d in docs), key=lambda x: (x is not None, x))
    whole = {}
    for r in token_files.read(spark, path).collect():
        whole.setdefault((r["shard"], r["start"]), []).append((r["at"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_id"]))
    at, by = 0, Counter()
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
        by[doc_id, n, crc] += 1
    want = Counter()
    for doc_id, t, *_ in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert by == want
    read = Counter((p[0][2], tuple(sum((x[1] for x in sorted(p)), []))) for p in whole.values())
    assert read == Counter((d[0], (*tok.encode(d[1] or "", add_special_tokens=False).ids, 2)) for d in docs)
    empty = str(tmp_path / "none")
    token_files.write(frame(spark, []), BPE, empty)
    assert token_files.digest(spark, empty).count() == 0


@given(st.binary(max_size=50), st.binary(max_size=5000))
def test_crc_ahead(a, b):
    assert token_files.crc_ahead(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def plain_audit(docs, least, top):
    upper = {c: c + 32 for c in range(65, 91)}
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(upper))) for _, t, la, so in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= least}
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, ws in own:
            count[s].update(w for w in ws if w in kept)
        whole = sum(count.values(), Counter())

        def p(c):
            return {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}

        q = p(whole)
        ps = {s: p(c) for s, c in count.items()}
        for s in count:
            found = [("pair", x, sum(abs(ps[s][w] - ps[x][w]) for w in kept)) for x in count if x != s]
            terms = [("term", w, ps[s][w] - q[w]) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for rows, most in ((found, len(found)), (terms, top)):
                for rank, (part, item, value) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("groups,terms,chunks", [(64, 2048, 64), (3, 5, 2)])
def test_audit_equals_plain_version(spark, monkeypatch, groups, terms, chunks):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "CHUNKS", chunks)
    rng = random.Random(2)
    words = [*"alpha Beta gamma DELTA épsilon ζeta éta Θ x1y a_b".split(), "😂z"]
    docs = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None, "f"])
        docs.append((i, " ".join(rng.choices(words, [3 + (source == "a"), *range(1, len(words))], k=rng.randint(0, 25))), lang, source))
    docs += [(900, None, "en", "only null"), (901, "", "xx", "one"), (902, "rare words", "xx", "two"), (902, "rare words", "xx", "two"), (None, "alpha", "de", "a")]
    got = divergence.audit(frame(spark, docs), least_docs=20, top=4, terms=terms)
    assert order(tuple(r) for r in got.collect()) == order(plain_audit(docs, 20, 4))
    assert divergence.audit(frame(spark, [])).count() == 0


def test_shares_are_exact():
    rng = random.Random(1)
    n = np.array([rng.randint(0, 10**13) for _ in range(500)], np.int64)
    whole = n + 5 + np.array([rng.randint(0, 10**15) for _ in range(500)], np.int64)
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (a + 5) // b for a, b in zip(n.tolist(), whole.tolist(), strict=True)]


def test_pieces_take_the_best_path_where_merges_give_it():
    from sentencepiece import SentencePieceProcessor

    rng, library = random.Random(4), SentencePieceProcessor(model_file=PIECES)
    made = ["".join(rng.choices("aaabbtheingsor é\n日", k=80)) for _ in range(400)] + ["the river runs over old stones", "", None]
    encoder = pieces.Encoder(PIECES)
    flat, edge, n, by_path = encoder.digest(made)
    for t, a, b in zip(made, edge, edge[1:], strict=False):
        assert flat[a:b].tolist() == library.encode(t or "")
    assert 0 < by_path.sum() < n.sum()  # both ways are taken
    path = pieces.Pieces(PIECES).encode(made)
    assert any(x.tolist() != flat[a:b].tolist() for x, a, b in zip(path, edge, edge[1:], strict=False))


def best_of(f, n=2):
    took = []
    for _ in range(n):
        a = time.perf_counter()
        f()
        took.append(time.perf_counter() - a)
    return min(took)


def test_lines_of_one_long_document_cost_linearly(spark):
    def run(n):
        gone = spark.createDataFrame([(1, "\n".join([f"line {i}" for i in range(n)] + ["r1", "r2", "r3"])), (0, "r1\nr2\nr3")], "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r for r in line_dedup.op10(gone).collect()}
        assert got[1]["n_removed"] == 3 and got[1]["text"] == "\n".join(f"line {i}" for i in range(n))

    run(1000)
    assert best_of(lambda: run(80_000)) < 4 * best_of(lambda: run(20_000)) + 2


def test_turns_of_one_long_conversation_cost_linearly(spark):
    def run(n):
        turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"turn {i} " + "wörd " * 40) for i in range(n)], "conv_id long, turn long, role string, text string").coalesce(1)
        r = next(r for r in chat.op5(turns).collect() if r["conv_id"] == 1)
        lost = "".join(f"turn {i} " + "wörd " * 40 for i in range(1, n, 2))
        assert r["n_turns"] == n and r["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()

    run(500)
    assert best_of(lambda: run(8000), 1) < 4 * best_of(lambda: run(2000), 1) + 4


def test_expected_pairs():
    rng = np.random.default_rng(0)
    post, trans = rng.dirichlet(np.ones(4), (5, 3)), rng.normal(size=(4, 4))
    m = post[:-1, :, :, None] * np.exp(trans) * post[1:, :, None, :]
    m /= m.sum(axis=(2, 3), keepdims=True)
    assert np.allclose(langid.expected_pairs(post, trans), m.sum(axis=(0, 1)))


def test_many_labels_stay_small(monkeypatch):
    import resource

    monkeypatch.setattr(langid, "STEPS", 16)
    rng = random.Random(0)
    k = 300
    alphabets = [rng.sample("abcdefghijklmnopqrstuvwxyz", 6) for _ in range(k)]
    sample = [(" ".join("".join(rng.choices(alphabets[i], k=6)) for _ in range(40)), f"l{i:04d}") for i in range(k) for _ in range(4)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    crf = langid.train(sample)
    assert len(crf.langs) == k and crf.weights.shape == (1 << 17, k)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # KB
    lang, _ = langid.Labeller(crf).languages([" ".join("".join(rng.choices(alphabets[i], k=6)) for _ in range(40)) for i in range(60)])
    assert np.mean([a == f"l{i:04d}" for i, a in enumerate(lang)]) > 0.5




def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, clashing names; then no rows at all."""
    import corpus_pipeline

    rng = random.Random(8)
    words = {"en": ["the", "river", "runs", "over", "old", "stones"], "de": ["der", "fluss", "über", "alte", "steine", "und"]}
    rows = [(i, " ".join(rng.choices(words[la], k=rng.randint(20, 60))), la, "s", 5, "x", 1.0) for i, la in enumerate(["en", "de"] * 40)]
    rows += [(500, None, "en", "s", None, None, None), (None, " ".join(rng.choices(words["en"], k=40)), None, None, 1, "x", 0.5), rows[0], rows[0], (501, "", "de", "s", 0, "y", 0.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double"
    for name, some in (("a", rows), ("b", [])):
        df = spark.createDataFrame(some, schema)
        df.repartition(2).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path / name))
            assert docs.columns == df.columns
        kept = docs.collect()
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if not some:
            assert not kept and not out
            continue
        ids = [r["doc_id"] for r in kept]
        assert 500 not in ids and 501 not in ids and ids.count(0) == 1 and None in ids and len(ids) > 60
        assert {r["doc_id"] for r in out} == set(ids)
