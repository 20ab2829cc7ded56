"""Encoders, language models, classifiers, pages and archives."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, language_id, lm_scoring, quality, token_files, warc
from tidemark.llm import sentencepiece_codec as codec
from tidemark.llm.common import column_words, shared_dir
from tidemark.llm.files import read_file, write_file

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "ab", "the", "ing", " ", "  ", "\n", "é", "中文", "0", "!", "aaaa", "▁", "tion", "\U0001f600", "foo,", "it's", "\t", "\xa0", "A."]


def texts(n=60, seed=1):
    g = random.Random(seed)
    return ["".join(g.choice(PARTS) for _ in range(g.randint(0, 150))) for _ in range(n)]


def test_word_hashes():
    rows = ["Hello  World\tfoo", "", None, "hello", "É É a" * 3, "w" * 200_000 + " x", "world\n "]
    h, at = column_words(pa.array(rows))
    own = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in rows]
    assert np.diff(at).tolist() == [len(w) for w in own]
    by = {}
    for w, x in zip([w for ws in own for w in ws], h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_pieces_are_the_library_s(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(100, None), (101, ""), (None, "abc abc"), (3, "again " * 700), (102, "中" * 1500)]
    sp = codec.codec(PIECES).sp
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    for giant, chunk in ((10**6, 10**6), (200, 64)):
        found = codec.decode(codec.encode(df, PIECES, keep=["doc_id", "text"], giant=giant, chunk=chunk), PIECES).collect()
        assert len(found) == len(rows)
        for r in found:
            assert np.frombuffer(r["ids"], "<u4").tolist() == sp.encode(r["text"] or "")
            assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    named = df.withColumn("Ids", F.lit(1)).withColumnRenamed("key", "_key")
    named = codec.decode(codec.encode(named, PIECES, giant=200, chunk=64).withColumn("Decoded", F.lit(1)), PIECES)
    assert named.columns == ["doc_id", "text", "_key", "ids", "decoded"] and named.count() == len(rows)
    d = {r["doc_id"]: r for r in codec.digests(df, PIECES, giant=200, chunk=64).collect()}
    assert d[3]["round_trip"] and d[3]["ids_crc32"] == zlib.crc32(np.array(sp.encode("again " * 700), "<u4").tobytes()) and d[100]["n_tokens"] == 0
    assert codec.digests(df.limit(0), PIECES).count() == 0


def test_every_character_is_walked_by_the_lattice(monkeypatch):
    c = codec.Codec(PIECES)
    text = c.sp.normalize(" ".join(texts(30, 9)) + " the  end " + "x" * 300 + "中" * 90)
    expected = np.array(c.sp.encode_as_ids(text.replace("▁", " ")[1:]), "<u4").tobytes()
    walked, real = [], c.path

    def path(word):
        walked.append(word)
        return real(word)

    c.path = path
    monkeypatch.setattr(c.sp, "encode", None)
    for by_word in (True, False):
        c.by_word = by_word
        for chunk in (50, 333):
            cuts = range(0, len(text), chunk)
            parts = []
            for cut in cuts:
                lo, hi = max(0, cut - c.longest), min(len(text), cut + chunk + c.longest)
                parts.append((text[lo:hi], cut - lo, cut + chunk - lo, cut == 0, cut == cuts[-1]))
            states = codec.best_states([codec.transfer(c, *p) for p in parts], codec.START, codec.START)
            ids = [codec.trace_back(c, body, left, cut, None if first else a, None if last else b) for (body, left, cut, first, last), a, b in zip(parts, states, states[1:], strict=False)]
            assert b"".join(ids) == expected
    assert c.encode([text.replace("▁", " ")[1:]]) == [expected] and walked


def test_max_plus_products_are_associative():
    g = random.Random(2)
    s = [(0, k) for k in range(4)]
    ms = [{a: {b: float(g.randint(-9, 0)) for b in s if g.random() < 0.6} for a in s} for _ in range(3)]
    clean = lambda m: {a: r for a, r in m.items() if r}
    assert clean(codec.product(codec.product(ms[0], ms[1]), ms[2])) == clean(codec.product(ms[0], codec.product(ms[1], ms[2])))


def test_token_code_round_trip():
    for values in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1001))):
        x = np.array(values, np.uint32)
        assert token_files.unpack(*token_files.pack(x), len(x)).tolist() == values
    ids, sizes = np.array([5, 5, 5, 70000, 2, 2**31], np.uint32), np.array([2, 0, 4])
    a, b = token_files.from_bytes(token_files.to_bytes(ids, sizes))
    assert a.tolist() == ids.tolist() and b.tolist() == sizes.tolist()
    with pytest.raises(ValueError):
        token_files.from_bytes(b"something else entirely, long enough to have a header.......")


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rows = [(k * 3, x) for k, x in enumerate(texts(50, 7) + ["one  two <|endoftext|> x", "plain words, only."])] + [(-4, None), (-3, "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, x, "y") for i, x in rows], "doc_id int, text string, start string").repartition(3)
    folder = f"{shared_dir(spark)}/tok"
    manifest = token_files.write_tokens(df, BYTES, folder, 2, file_ids=500)
    assert manifest.count() > 4
    got = {r["doc_id"]: r for r in token_files.read_tokens(manifest, folder, with_ids=True).collect()}
    at = 0
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)
    assert token_files.round_trip(df.limit(0), BYTES, 2).count() == 0


def test_token_files_of_repeated_ids_and_long_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    long = "very long text, it goes on. " * 40_000
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, long), (2, "x" * 300_000), (None, "d"), (None, None)]
    got = token_files.round_trip(spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, seq int"), BYTES, 2).collect()
    raw = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(raw(x)) // 4, zlib.crc32(raw(x))) for i, x in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, 1, 1, 1, 2, 2]


class CountedTokenizer:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_beside_line_feeds_and_marks_are_encoded_once():
    words = [a + b for a in ("stone", "river", "cloud", "meadow") for b in ("ing", "ed", "er", "s", "ly")]
    lines = [f"{a}{m}\n{b.title()} {a}{m}" for a in words for b in words for m in (".", ",", "!!", "***")]
    e = token_files.Encoder(BYTES)
    plain = e.tokenizer
    e.tokenizer = CountedTokenizer(plain)
    got = e.encode(lines)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [plain.encode(x, add_special_tokens=False).ids for x in lines]
    assert e.tokenizer.seen < 10 * sum(map(len, words)) < sum(map(len, lines)) / 20
    e.encode(lines)
    assert e.tokenizer.seen < 10 * sum(map(len, words))


@pytest.mark.parametrize("most", [900_000, 60, 0])
def test_odd_texts_have_the_ids_of_the_library(most, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", most)
    monkeypatch.setattr(token_files, "JOINED_WORDS", 7)
    g, e = random.Random(most), token_files.Encoder(BYTES)
    some = ["a", "b", "The", "é", "中文字", "ة", "10", "'s", "'", "'re", "!", ",", "***", "\n", "\n", "\n\n", " ", " ", " ", "  ", "\t", "\u0301", "\u0120", "\u010a", "<|endoftext|>", "\r", "\r0", "x" * 50, "\U0001f600", "\u3000", "²", "ª"]
    for _ in range(12):
        odd = ["".join(g.choices(some, k=g.randint(0, 30))) for _ in range(100)]
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(odd)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]
    assert e.used <= most + 200 and e.encode([]) == [] and e.encode([""]) == [b""]


def test_token_files_end_with_the_document_that_fills_them(spark):
    df = spark.createDataFrame([(k, "some words " * (k % 7) + "x") for k in range(300)], "doc_id long, text string").coalesce(1)
    folder = f"{shared_dir(spark)}/tok-ends"
    manifest = token_files.write_tokens(df, BYTES, folder, 2, file_ids=100)
    sizes = {r["doc_id"]: r["n_tokens"] for r in token_files.read_tokens(manifest, folder).collect()}
    rows = manifest.collect()
    last = {p: max(r["seq"] for r in rows if r["part"] == p) for p in {r["part"] for r in rows}}
    for r in rows:
        assert r["n_ids"] == sum(sizes[i] for i in r["doc_ids"]) and r["n_docs"] == len(r["doc_ids"])
        assert r["n_ids"] - sizes[r["doc_ids"][-1]] < 100 and (r["n_ids"] >= 100 or r["seq"] == last[r["part"]])
    assert sorted(i for r in rows for i in r["doc_ids"]) == list(range(300))


def test_a_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocab = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz .,")} | {"[UNK]": 40, "a ": 41, "a b": 42}
    other = Tokenizer(models.WordPiece(vocab | {f"##{c}": 50 + k for k, c in enumerate(vocab)}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Split(Regex("\n"), "isolated")
    other.save(str(tmp_path / "other.json"))
    e = token_files.Encoder(str(tmp_path / "other.json"))
    assert not e.by_word and token_files.Encoder(BYTES).by_word
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(["a b", "ab a b"])] == [other.encode(x).ids for x in ("a b", "ab a b")]


def test_files(spark):
    name = write_file(f"{shared_dir(spark)}/raw", "a", ".bin", b"abc")
    assert read_file(f"{shared_dir(spark)}/raw", name) == b"abc"


def tokens(t):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None]


@pytest.mark.parametrize(("frequent", "block"), [(1_000_000, 1 << 28), (3, 3000)])
def test_lm_scores(spark, frequent, block):
    g = random.Random(4)
    zipf = lambda: f"w{min(int(g.paretovariate(0.7)), 400)}"
    rows = [(k, " ".join(zipf() for _ in range(g.randint(0, 60)))) for k in range(120)] + [(200, None), (201, ""), (202, "never seen"), (7, "W1 w1"), (None, "w2")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    learn = [t for i, t in rows if i is not None and i % 5]
    model = lm_scoring.train(docs.filter("doc_id % 5 <> 0"))
    got = Counter()
    c, pairs = Counter(), Counter()
    for t in learn:
        w = tokens(t)
        c.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    for r in lm_scoring.score(docs, model, frequent=frequent, block_bytes=block).collect():
        got[r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)] += 1
        text = next(t for i, t in rows if i == r["doc_id"])
        if r["n_tokens"] == len(tokens(text)):
            w = tokens(text)
            seen = lambda a: len(learn) if a == "<s>" else c[a]
            own = lambda a: 0.5 * seen(a) / (seen(a) + 1)
            p = [own(a) * pairs[a, b] / max(1, seen(a)) + (1 - own(a)) * (c[b] + 0.1) / (n + 0.1 * (v + 1)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)]
            assert abs(r["score"] - sum(map(math.log10, p))) <= 0.12 * len(w) + 1e-9
    expected = Counter()
    for i, t in rows:
        w = tokens(t)
        expected[i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    assert got == expected


def test_probabilities_of_what_may_follow_sum_to_one():
    learn = [tokens(t) for t in ("a b a c", "a b", "d")]
    c = Counter(x for t in learn for x in t)
    pairs = Counter(p for t in learn for p in zip(["<s>", *t[:-1]], t, strict=True))
    n, kinds = sum(c.values()), [*c, b"unknown"]
    for before in ["<s>", b"a", b"b", b"d", b"never"]:
        seen = len(learn) if before == "<s>" else c[before]
        p = lm_scoring.probabilities(np.array([c[w] for w in kinds], float), np.array([pairs[before, w] for w in kinds], float), np.full(len(kinds), float(seen)), (0.1, n + 0.1 * len(kinds)))
        assert math.isclose(p.sum(), 1.0) and (p > 0).all()


def test_a_bucket_asked_for_a_lot_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "ASKED_BYTES", 64)
    rows = [(k, "hot cold " * (1 + k % 5) + f"w{k % 7}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = lm_scoring.train(docs)
    few, all_ = (lm_scoring.score(docs, model, frequent=f).select("doc_id", "n_known", F.round("base_score", 6)) for f in (1, 1000))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_.collect()))


def test_a_very_long_text_is_scored_whole(spark):
    docs = spark.createDataFrame([(1, "one two three " * 300_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in lm_scoring.score(docs, lm_scoring.train(docs)).collect()}
    assert got == {1: 900_001, 2: 2}


def test_lm_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_scoring.score(docs, lm_scoring.train(docs.limit(0))).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"])


def test_filter_reads_back_counts():
    g = np.random.default_rng(3)
    h, n = g.integers(0, 2**63, 5000, dtype=np.uint64), g.integers(1, 1000, 5000)
    with np.errstate(over="ignore"):
        words = lm_scoring.build_filter(h, n)
        f = lm_scoring.Filter(1, 0, 1, [words, words], [np.zeros(1, np.int64)] * 2, [np.array([len(words)])] * 2)
        out, other = np.zeros(5000), np.zeros(5000)
        f.fill(0, h, np.zeros(5000, np.int64), out)
        f.fill(0, g.integers(0, 2**63, 5000, dtype=np.uint64), np.zeros(5000, np.int64), other)
    assert (lm_scoring.levels(np.maximum(out, 1)) >= lm_scoring.levels(n)).all() and (np.abs(out / n - 1) < 0.35).mean() > 0.9 and (other > 0).mean() < 0.1


def labelled(n=300):
    g = random.Random(8)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(g.randint(2, 7)))
    rows = []
    for k in range(n):
        w = [word() for _ in range(g.randint(5, 300))]
        good = k % 3 != 0
        rows.append((k, " ".join(w if good else [x.upper() + "!!" for x in w]), int(good)))
    return rows


def test_quality(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(900, None, "z"), (901, "", "z"), (902, "long words " * 50_000, "z"), (None, "x", "z")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(q) for i, _, q in rows if i % 5 == 0]
    assert sum(held) / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) + 4
    kept = quality.score(docs, model, at_least=0.5)
    assert kept.columns == ["doc_id", "text", "label"] and kept.count() == sum(s >= 0.5 for s in got.values())
    named = quality.score(docs.withColumnRenamed("label", "Score"), model)
    assert named.columns == ["doc_id", "text", "score"] and {r["doc_id"]: r["score"] for r in named.collect()} == got
    twice = quality.fit(docs.unionByName(docs), labels, F.col("doc_id") % 5 != 0)
    assert all((twice.p[k] == v).all() for k, v in model.p.items())
    none = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.filter("doc_id = 1"), none).first()["score"] == 0.5
    assert quality.score(docs.limit(0), none).count() == 0


def bags_of(rows):
    return quality.Bags.of(*quality.text_bytes(pa.array(rows, pa.string())))


def test_quality_reads_all_passages_and_words(monkeypatch):
    sizes = [100 * quality.PASSAGE - 7, 3, 0]
    texts = ["word " * (n // 5) + "x" * (n % 5) for n in sizes]
    batch = pa.RecordBatch.from_pydict({"part": pa.array([1, 1, 2], pa.int32()), "label": pa.array([1, 0, 0], pa.int32()), "text": pa.array(texts)})
    made = pa.Table.from_batches(quality._bags([batch]))
    assert [len(r) // 2 // (quality.WIDTH - 1) for r in made["counts"].to_pylist()] == [100, 1, 1]
    assert [len(r) // 2 for r in made["words"].to_pylist()] == [len(t.split()) for t in texts]
    (part, bags, y), (other, *_) = quality._steps(made.to_batches())
    whole = bags_of(texts[:2])
    assert (part, other, y.tolist()) == (1, 2, [1, 0]) and (bags.counts == whole.counts).all() and (bags.words == whole.words).all() and (bags.word_first == whole.word_first).all()
    # a part of the passages at a time comes to the same
    m = quality.AttentionModel()
    m.p["E"][:] = np.random.default_rng(1).normal(size=m.p["E"].shape) * 0.1
    full, score = m.gradients(bags, y), m.score(bags)
    monkeypatch.setattr(quality, "STEP_PASSAGES", 7)
    for k, part in m.gradients(bags, y).items():
        assert np.allclose(part, full[k], atol=1e-5), k
    assert np.allclose(m.score(bags), score, atol=1e-6)


def test_words_belong_to_the_passage_they_begin_in():
    g = random.Random(3)
    rows = [" ".join("".join(g.choice("abé") for _ in range(g.randint(1, 40))) for _ in range(g.randint(0, 90))) for _ in range(20)] + ["", None, "  x", "y" * 1300 + " Z"]
    bags = bags_of(rows)
    place, known = 0, {}
    for k, text in enumerate(rows):
        raw = (text or "").encode()
        own = [[] for _ in range(max(1, -(-len(raw) // quality.PASSAGE)))]
        for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
            own[m.start() // quality.PASSAGE].append(m[0].lower())
        assert bags.first[k] == place
        for words in own:
            got = bags.words[bags.word_first[place] : bags.word_first[place + 1]].tolist()
            assert len(got) == len(words) and all(known.setdefault(w, b) == b for w, b in zip(words, got, strict=True))
            place += 1
    assert len(bags.word_first) == place + 1 and len(set(known.values())) > 0.7 * len(known)


def test_quality_scores_are_those_of_brute_force():
    g = random.Random(2)
    rows = ["", "short one.", "Mixed 123, and MORE!! (of it) " * 60, "é" * 700 + "x" * 5, "a\nb " * 900, None]
    m = quality.AttentionModel(seed=3)
    m.mean, m.std = np.full(quality.WIDTH, 0.1, np.float32), np.full(quality.WIDTH, 0.7, np.float32)
    m.p["c0"][:], m.p["bv"][:], m.p["bu"][:] = 0.2, 0.05, -0.1
    m.p["E"][:] = np.random.default_rng(2).normal(size=m.p["E"].shape) * 0.2
    bags = bags_of(rows)
    got, place = m.score(bags), 0
    p, sigmoid = {k: v.astype(float) for k, v in m.p.items()}, lambda x: 1 / (1 + np.exp(-x))
    kind = lambda b: next((k + 1 for k, c in enumerate(quality.CLASSES) if b in c), 0)
    for k, text in enumerate(rows):
        raw = (text or "").encode()
        hidden, weights = [], []
        for at in range(0, max(1, len(raw)), quality.PASSAGE):
            own = [kind(b) for b in raw[at : at + quality.PASSAGE]]
            n = len(quality.CLASSES) + 1
            x = np.zeros(quality.WIDTH)
            for a in own:
                x[a] += 1
            for a, b in zip(own, own[1:], strict=False):
                x[n + b * n + a] += 1
            x[:-1] = np.sqrt(x[:-1] / max(1, len(own)))
            x[-1] = len(own) / quality.PASSAGE
            words = bags.words[bags.word_first[place] : bags.word_first[place + 1]]
            place += 1
            vectors = sum((p["E"][w] for w in words), np.zeros(m.HIDDEN)) / max(1, len(words)) ** 0.5
            h = np.tanh((x - m.mean) / m.std @ p["W"] + p["b"] + vectors)
            hidden.append(h)
            weights.append(math.exp((np.tanh(h @ p["V"] + p["bv"]) * sigmoid(h @ p["U"] + p["bu"])) @ p["w"]))
        z = sum(w * h for w, h in zip(weights, hidden, strict=True)) / sum(weights)
        assert math.isclose(got[k], sigmoid(z @ p["c"] + p["c0"][0]), abs_tol=1e-5) and g


def test_attention_gradients():
    m = quality.AttentionModel()
    g = np.random.default_rng(0)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    m.p["E"][:] = g.normal(size=m.p["E"].shape) * 0.3
    bags = bags_of(["one two, three " * 60, "", "UPPER 12 lower", "x", "a b c d " * 200, "one two"])
    y = np.array([0, 1, 0, 1, 1, 0.0])

    def loss():
        p = m.score(bags)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = m.gradients(bags, y)
    one = int(bags.words[0])
    for k, at in (("W", (3, 2)), ("V", (1, 1)), ("U", (2, 0)), ("w", (1,)), ("c", (4,)), ("bv", (2,)), ("E", (one, 3)), ("E", (int(bags.words[-1]), 0)), ("b", (5,)), ("c0", (0,))):
        eps = 1e-5
        m.p[k][at] += eps
        up = loss()
        m.p[k][at] -= 2 * eps
        down = loss()
        m.p[k][at] += eps
        assert math.isclose((up - down) / (2 * eps), grads[k][at], rel_tol=2e-3, abs_tol=1e-6), k
    assert np.abs(grads["E"]).sum(axis=1).nonzero()[0].tolist() == sorted(set(bags.words.tolist()))


def test_words_of_one_shape_are_told_apart(spark):
    """What a text says counts, not its spelling's shape alone."""
    g = random.Random(9)
    lists = [["".join(g.choice("abcdefghij") for _ in range(5)) for _ in range(150)] for _ in range(2)]
    rows = [(k, " ".join(g.choice(lists[k % 2]) for _ in range(60)), k % 2) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs, docs, F.col("doc_id") % 5 != 0)
    got = quality.score(docs.filter("doc_id % 5 = 0"), model).select("quality", "score").collect()
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in got) >= 0.9 * len(got)


def test_learners_state_is_all_that_goes_round():
    a, b = (quality.Learner.new(quality.AttentionModel()) for _ in range(2))
    bags, y = bags_of(["good words here", "BAD!! 12"]), np.array([1, 0], np.float32)
    for _ in range(3):
        a.step(bags, y)
    b.unpack(np.frombuffer(a.packed()))
    b.steps = a.steps
    a.step(bags, y)
    b.step(bags, y)
    assert all(np.allclose(b.model.p[k], v, atol=1e-6) for k, v in a.model.p.items())



def test_languages(spark):
    g = random.Random(6)
    kinds = {"xa": "abcde", "xb": "fghij", "xc": "абвгд"}
    words = lambda lang, n: " ".join("".join(g.choice(kinds[lang]) for _ in range(g.randint(2, 6))) for _ in range(n))
    rows = [(k, words(lang, 40), lang) for k, lang in enumerate(sorted(kinds) * 30)] + [(500, "bad fad", None), (501, None, "xa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") % 3 != 1)
    assert model.langs == ["xa", "xb", "xc"] or model.langs == ["xa", "xc"]
    model = language_id.fit(docs, F.col("doc_id") % 7 != 1)
    a, b = words("xa", 30), words("xc", 20)
    ask = spark.createDataFrame([(1, f"{a} {b}"), (2, None), (3, "12 !"), (4, words("xb", 20)), (5, ""), (6, "e " * 40_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(ask, model).collect()}
    assert [(s["lang"], s["start"], s["end"]) for s in got[1]["spans"]] == [("xa", 0, len(a)), ("xc", len(a) + 1, len(a) + 1 + len(b))]
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (2, 3, 5)] == [("und", 0.0)] * 3 and got[4]["lang_pred"] == "xb" and got[6]["lang_pred"] == "xa"
    nothing = language_id.fit(docs.limit(0))
    assert language_id.predict(ask, nothing).filter("lang_pred <> 'und'").count() == 0
    got = language_id.predict(docs.withColumnRenamed("lang", "Score"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "spans"] and dict(got.dtypes)["score"] == "double"
    assert got.count() == len(rows)


def test_any_number_of_languages(spark):
    g = random.Random(3)
    own = {f"l{k:03d}": ["".join(g.choice("abcdefghij") for _ in range(4)) for _ in range(12)] for k in range(600)}
    rows = [(k * 600 + j, " ".join(g.choices(words, k=30)), lang) for j, (lang, words) in enumerate(own.items()) for k in range(2)] + [(None, "aaaa bbbb", "l000"), (None, "cccc", "digits"), (None, "12", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, whole = language_id.fit(docs), language_id.fit(docs, block_langs=10_000)
    assert len(model.langs) == 602 and len(model.files) == 10 and whole.langs == model.langs and not whole.files
    ask = spark.createDataFrame([(k, " ".join(g.choices(own[lang], k=20)), lang) for k, lang in enumerate(list(own)[::20])] + [(900, " ".join(own["l001"] + own["l002"]), None)], "doc_id long, text string, real string")
    got = language_id.predict(ask, model).orderBy("doc_id").collect()
    assert got == language_id.predict(ask, whole).orderBy("doc_id").collect()
    assert sum(r["lang_pred"] == r["real"] for r in got) >= 28 and [x["lang"] for x in got[-1]["spans"]] == ["l001", "l002"]


def test_counts_of_features_are_those_of_brute_force():
    texts = ["abc ab", None, "αβ a1b", "", "x"]
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["p", "p", "q", "q", "r"]), "text": pa.array(texts)})
    got = Counter()
    for b in language_id._count([batch]):
        for r in b.to_pylist():
            got[r["lang"], r["feature"]] += r["n"]
    expected = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
        w = language_id.Words([text])
        for k, x in enumerate(w.triple.tolist()):
            expected[lang, x] += 1
            expected[lang, language_id.BUCKETS + int(w.pair[k])] += 1
        for script, n in zip(w.script.tolist(), w.lengths.tolist(), strict=True):
            expected[lang, 2 * language_id.BUCKETS + script] += n
    assert +got == +expected and {x[0] for x in got} == {"p", "q", "r"}


def brute_viterbi(s, pen):
    best = None
    import itertools

    for path in itertools.product(range(s.shape[1]), repeat=len(s)):
        v = sum(s[k, p] for k, p in enumerate(path)) - pen * sum(a != b for a, b in zip(path, path[1:], strict=False))
        if best is None or v > best[0] + 1e-9:
            best = (v, path)
    return best[0]


def test_viterbi_is_best():
    g = np.random.default_rng(2)
    sizes = [0, 1, 5, 3, 0, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    s = g.standard_normal((first[-1], 3)).astype(np.float32) * 3
    lang = language_id.viterbi(s, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        p = lang[a:b]
        if b > a:
            v = sum(s[a + k, x] for k, x in enumerate(p)) - 2.0 * (np.diff(p) != 0).sum()
            assert math.isclose(v, brute_viterbi(s[a:b], 2.0), rel_tol=1e-5)


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='nav-open'><nav><a>Menu</a></nav><div class='ad'>Buy</div><main><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b><br>three\n four<p>five &lt;six&gt;<aside>side</aside><form>f</form><ul><li>i<li>j</ul><div class=x7>Sign up here</div></article><section id=comments><article>c</article></section></main><footer>&copy; F</footer></body>"


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\n\nOne two three four\n\nfive <six>\n\ni\n\nj\n\nSign up here"
    assert html_text.main_text("plain & text") == "plain & text" and html_text.main_text("<p>a<!-- <p>b --><p>c <3") == "a\n\nc <3"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_text_beside_articles_stays():
    card = "<article><h3>Card</h3></article>"
    assert html_text.main_text(f"<body><nav>n</nav><main><header><h1>Title</h1></header><p>Story{card}<div>end</div></main><footer>f</footer></body>") == "Title\n\nStory\n\nCard\n\nend"
    assert html_text.main_text(f"<body><header>Site</header><div>Story</div>{card}<section><header>Part</header>more</section></body>after") == "Story\n\nCard\n\nPart\n\nmore\n\nafter"
    assert html_text.main_text(f"<body><p>out</p><main>one</main>{card}<main>two</main></body>") == "one\n\nCard\n\ntwo"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class='content has-sidebar'><article><p>Story</p></article></div></body>", "Story"),
        ("<body><div class='no-sidebar'><p>Story of some words</p></div></body>", "Story of some words"),
        ("<body><div class='wrapper menu-open'><p>Story</p><div class=menu>m</div></div></body>", "Story"),
        ("<body><article class='post share-buttons-on'><p>Story</p></article></body>", "Story"),
        ("<body><article><p class='notice'>Mind</p><p>Story</p></article></body>", "Mind\n\nStory"),
        ("<body><article><h2 class='social'>Head</h2><p>Story</p></article></body>", "Head\n\nStory"),
        ("<body><form action=x><div class=sidebar>s</div><main><p>Story</p></main><input value=v></form></body>", "Story"),
        ("<body><div class='sidebar'><article><h1>T</h1>Story</article></div><aside><article>A card of more words than the story</article></aside></body>", "T\n\nStory"),
        ("<body><article>Story</article><div class=ad>Longer than the story</div><section id=comments><article>And the longest of all of them</article></section></body>", "Story"),
        ("<body><div class='widget-box'>All that the page has to say</div></body>", "All that the page has to say"),
        ("<body><article></article><div class=ad>Buy</div></body>", ""),
        ("<body><article>Story</article><div class='cookie-notice bottom'>c</div><div class=comment-list>d</div></body>", "Story"),
    ],
)
def test_names_take_out_no_article(page, text):
    assert html_text.main_text(page) == text


def test_template_counts_are_those_of_brute_force(spark):
    g = random.Random(12)
    parts = ["<nav><ul><li>Home</li><li>News</li></ul></nav>", "<div class=ad>Buy one of these for little</div>", "<footer>All rights</footer>", "<div><p>Seen on this site today and always</p></div>", "<div class=q>x</div>"]
    rows = [(k, g.choice(["http://a.example/", "http://b.example/", None]), "<body>" + "".join(g.sample(parts, g.randint(0, 5))) + f"<article><p>Story {k // 2}</p></article></body>") for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.templates(pages.select(html_text.host_of(F.col("url")).alias("host"), "html"), many_pages=12, many_share=0.3).collect()
    on, distinct = {}, {}
    for _, url, page in rows:
        host = re.sub("^http://|/$", "", url or "")
        distinct.setdefault(host, set()).add(page)
        for n in html_text.candidates(html_text.measure(html_text.parse(page))):
            on.setdefault((host, n.hash, n.words), set()).add(page)
    expected = {}
    for (host, h, words), where in on.items():
        n, of = len(where), len(distinct[host])
        if n >= 5 and 2 * n >= of or n >= 12 and n >= 0.3 * of and words >= 5:
            expected.setdefault(host, set()).add(h)
    assert {r["host"]: set(r["hashes"]) for r in found} == expected and sum(map(len, expected.values())) > 6
    gone = html_text.extract(pages).agg(F.sum("n_removed")).first()[0]
    assert gone > 100


def test_templates_go(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("five", f"page {k}")) for k in range(12)]
    rows += [(20, "http://other.example/", PAGE), (21, None, None), (22, "http://h.example/x", ""), (20, "http://other.example/", PAGE)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, host string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[3] == "One two three four\n\npage 3 <six>\n\ni\n\nj" and by[20].endswith("Sign up here") and by[21] == by[22] == ""
    assert all(r["n_chars"] == len(r["text"]) and r["host"] == "e" for r in got)
    other = html_text.extract(pages.withColumnsRenamed({"html": "body", "host": "html"}).withColumn("Text", F.lit(1)), html_col="body")
    assert other.columns == ["page_id", "url", "html", "text", "n_chars", "n_removed"] and {r["page_id"]: r["text"] for r in other.collect()} == by
    assert html_text.extract(pages.limit(0)).count() == 0


def test_a_story_on_many_pages_stays(spark):
    """A wire story under other titles, whatever it is wrapped in; what surrounds it goes."""
    story = "<p>A wire story of some length is told here.</p><p>It goes on for a while, and then it ends.</p>"
    told = "A wire story of some length is told here.\n\nIt goes on for a while, and then it ends."
    wraps = {
        "a": '<article><h1>T{k}</h1><div class="body">%s</div><div class="box"><p>Read our other pages as well today</p></div></article>',
        "b": '<article><h1>T{k}</h1><div><div class="w1"><div>%s</div></div></div><div class="related"><p>Read our other pages as well today</p></div></article>',
        "c": '<main><h1>T{k}</h1><section><div class="lead">%s</div></section></main><div class="box"><p>Read our other pages as well today</p></div>',
    }
    rows = []
    for host, wrap in wraps.items():
        rows += [(host, k, f"http://{host}.example/{k}", "<body>" + (wrap % story).replace("{k}", str(k)) + "</body>") for k in range(10)]
        rows += [(host, k, f"http://{host}.example/{k}", "<body>" + (wrap % f"<p>Another story, number {k}, which no other page tells.</p>").replace("{k}", str(k)) + "</body>") for k in range(10, 200)]
    long = " ".join(f"word{k}" for k in range(80))
    rows += [("d", k, f"http://d.example/{k}", f"<body><div><h2>Title {k}</h2><div class=text><p>{long}</p></div></div><div><p>Read our other pages as well today</p></div></body>") for k in range(12)]
    got = html_text.extract(spark.createDataFrame(rows, "host string, k int, url string, html string")).collect()
    for r in got:
        if r["host"] == "d":
            assert r["text"] == f"Title {r['k']}\n\n{long}"
        else:
            assert r["text"] == f"T{r['k']}\n\n" + (told if r["k"] < 10 else f"Another story, number {r['k']}, which no other page tells.")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Let <math><mi>x</mi></math> be a number.</p></article>", "Let x be a number."),
        ("<article><p>See</p><object data=x><p>the fallback</p></object></article>", "See\n\nthe fallback"),
        ('<article><p>Story</p></article><section id="reader-comments"><p>I agree</p></section><div class="user-feedback"><p>Me too</p></div>', "Story"),
        ('<body class="has-comments"><h1>T</h1><div class="comment-count">Story of comments</div></body>', "T\n\nStory of comments"),
        ("<body><div><h1>T</h1><p>Story</p></div><div><h3>3 Comments</h3><p>I agree</p></div></body>", "T\n\nStory"),
        ("<article><h1>T</h1><p>Story is longer than that</p><h2>Leave a reply</h2><p>I agree</p></article>", "T\n\nStory is longer than that"),
        ("<article><h1>T</h1><h2>Comments</h2><p>That is the heading of a long chapter on comments in law</p><h2>More</h2><p>x</p></article>", "T\n\nComments\n\nThat is the heading of a long chapter on comments in law\n\nMore\n\nx"),
        ('<body><article><h1>T</h1><p>Story</p></article><div class="x"><div class="r"><span class="u-author">Ann</span><p>Nice</p></div><div class="r"><span class="u-author">Bob</span><p>No</p></div></div></body>', "T\n\nStory"),
        ('<body><article><h1>T</h1><p>Story</p></article><ul><li itemprop="comment"><p>Nice</p></li></ul></body>', "T\n\nStory"),
        ('<main><h1>T</h1><div class="r"><time>1999</time><p>First entry of a diary</p></div><div class="r"><time>2000</time><p>Second entry</p></div></main>', "T\n\n1999\n\nFirst entry of a diary\n\n2000\n\nSecond entry"),
    ],
)
def test_comments_by_shape_and_kept_elements(page, text):
    assert html_text.main_text(page) == text


def test_templates_are_counted_on_distinct_pages(spark):
    page = "<body><div class=x1>{notice}</div><div class=x2><h2>Size</h2>Story {k} is told here</div></body>"
    notices = [f"Notice {k} of this site is shown today" for k in range(4)]
    rows = [("http://big.example/", page.format(notice=notices[k % 4], k=k)) for k in range(480)]
    rows += [("http://copies.example/", page.format(notice="One page only", k=0))] * 6 + [("http://copies.example/", page.format(notice=f"Other {k}", k=k)) for k in range(1, 5)]
    rows += [(None, page.format(notice="Short", k=1000 + k)) for k in range(120)] + [(None, f"<p>Unlike {k}</p>") for k in range(130)]
    got = html_text.extract(spark.createDataFrame(rows, "url string, html string").withColumn("html_", F.col("html")), keep=["url", "html_"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["url"], []).append(r["text"])
    assert len(got) == len(rows)
    # each notice is on a quarter of the host's pages: a template; the heading is on all of them
    assert sorted(by["http://big.example/"]) == sorted(f"Story {k} is told here" for k in range(480))
    # copies of one page are one page; only the heading is on five distinct ones
    assert by["http://copies.example/"].count("One page only\n\nStory 0 is told here") == 6
    # short blocks on less than half of the pages stay
    assert sum(t.startswith("Short\n\nSize\n\nStory") for t in by[None]) == 120


def test_archives(spark):
    rows = [(k, f"http://x/{k} a", "same page") for k in range(8)] + [(10, None, None), (11, "u", ""), (12, "u", "é\r\n\r\nbody"), (None, "u", "same page"), (12, "u", "é\r\n\r\nbody"), (13, "u", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max((x for x in (keep.get(h or ""), i) if x is not None), default=None)
    expected = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        k = keep[h or ""]
        expected[i, len(p), warc.payload_digest(p), "response" if i == k else "revisit", None if i == k else k] += 1
    assert Counter((r["id"], r["bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in got) == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_no_revisits(spark):
    heads = spark.createDataFrame([(1, 5, "A", 3), (2, 5, "A", 3), (3, 6, "B", 30), (4, 6, "B", 30)], "id long, key long, digest string, bytes long")
    assert {r["id"]: r["keep"] for r in warc.decide(heads, 10).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_a_record_holds_its_digest():
    raw = next(warc.members(warc.record("response", "urn:a", 7, "http://x", warc.payload_digest(b"abc"), b"abc", "2020-01-01T00:00:00Z")))
    fields, payload = warc.parse(raw)
    assert payload == b"abc" and fields["warc-type"] == "response" and hashlib.sha1(payload).digest() == __import__("base64").b32decode(fields["warc-payload-digest"][5:])


def test_headers_are_fresh(spark):
    rows = [(k, f"http://x/{k}", "same page" if k % 3 else f"page {k}") for k in range(30)] + [(29, "http://x/again", "same page"), (None, None, "same page"), (40, "http://x/40", "é" * 3_000_000), (41, "http://x/41", "é" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    ids, revisits, dates = [], [], set()
    for run in range(2):
        folder = f"{shared_dir(spark)}/fresh{run}"
        for file in warc.write_archives(pages, folder).collect():
            kinds = []
            for raw in warc.members(read_file(folder, file["file"])):
                fields, _ = warc.parse(raw)
                ids.append(fields["warc-record-id"])
                kinds.append(fields["warc-type"])
                dates.add(fields["warc-date"])
                if kinds[-1] == "revisit":
                    revisits.append(fields)
            assert kinds.count("warcinfo") == 1 == 1 + kinds.index("warcinfo") and len(kinds) == file["n_records"] + 1
    assert len(set(ids)) == len(ids) and all(x.startswith("<urn:uuid:") for x in ids) and all(d > "2024" for d in dates)
    assert len(revisits) == 2 * 21 and all(r["warc-refers-to-date"] in dates and r["warc-profile"] == warc.PROFILE for r in revisits)
    # a response that is one row alone is named by its record id
    named = [r for r in revisits if r["x-refers-to-row-id"] == "41"]
    assert [r["warc-refers-to-target-uri"] for r in named] == ["http://x/41"] * 2 and all(r["warc-refers-to"] in ids for r in named)
    assert all("warc-refers-to" not in r for r in revisits if r["x-refers-to-row-id"] == "29")


def test_archives_are_read_in_time_in_proportion():
    import time

    one = warc.record("response", "urn:a", 1, "http://x", "D", bytes(np.random.default_rng(1).integers(0, 256, 300, np.uint8)), "2020-01-01T00:00:00Z")

    def took(n):
        began = time.perf_counter()
        assert sum(1 for _ in warc.members(one * n)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(16_000) < 10 * took(4_000) + 0.5
