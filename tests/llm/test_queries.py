"""Every registered query against its contract, on a small table with nulls, repeated rows and a very long text, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from base64 import b32encode
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars int",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
}


def tables():
    g = random.Random(5)
    kinds = {"en": "abcdefgh", "xx": "ijklmnop"}
    word = lambda lang: "".join(g.choice(kinds[lang]) for _ in range(g.randint(2, 6)))
    docs, labels = [], []
    for k in range(160):
        lang = "en" if k % 2 else "xx"
        w = [word(lang) for _ in range(g.randint(6, 60))]
        bad = k % 5 == 3
        if k % 20 == 7:
            w[3:3] = ITEM.upper().split()
        docs.append((k, " ".join(x + "!!##" for x in w) if bad else " ".join(w), lang, "hot", 1))
        labels.append((k, int(not bad), 0))
    docs += [(200 + k, docs[k][1].upper() if k % 2 else docs[k][1], "en", "hot", 1) for k in range(6)]  # copies
    docs += [(300 + k, docs[10 + k][1] + " tail", None, "hot", 1) for k in range(6)]  # near copies
    docs += [(400, None, None, None, None), (401, "", "en", "hot", 0), (402, " \n", None, "hot", 2), (403, "abc def " * 60_000, "en", "hot", 1), (404, "12 !", None, "hot", 1), (5, docs[5][1], "en", "hot", 1)]
    page = "<html><body><nav><a>Home</a></nav><div class='ad'>Buy {k}</div><article><h1>Title {k}</h1><p>Some &amp; text\n {k}</p></article><footer>f</footer></body></html>"
    pages = [(k, f"http://h{k % 3}.example/{k}", page.format(k=k // 2 * 2)) for k in range(20)] + [(50, None, None), (51, "u", ""), (52, "http://h1.example/l", "<p>" + "long text " * 50_000 + "</p>")]
    return {"documents": docs, "benchmark": [(1, ITEM), (2, None), (3, "12")], "labels": labels + [(5, None, 0), (None, 1, 0), (9999, 0, 0)], "pages": pages}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = tables()
    for kind, found in (("full", rows), ("none", {k: [] for k in rows})):
        for name, own in found.items():
            spark.createDataFrame(own, SCHEMAS[name]).repartition(3).write.parquet(f"{root}/{kind}/{name}.parquet")
    return str(root), rows


def run(spark, folders, name, *columns):
    found = queries.queries()[name](spark, f"{folders[0]}/full")
    assert set(columns) <= set(found.columns)
    assert queries.queries()[name](spark, f"{folders[0]}/none").count() == 0
    return found.select(*columns).collect(), folders[1]


def test_op1(spark, folders):
    got, rows = run(spark, folders, "op1_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    item = words(ITEM)
    expected = Counter()
    for i, text, *_ in rows["documents"]:
        w, hit, ids = words(text), set(), set()
        for n, windows, name in ((13, [item[k : k + 13] for k in range(len(item) - 12)], "1"), (1, [["12"]], "3")):
            for k in range(len(w) - n + 1):
                if w[k : k + n] in windows:
                    hit |= set(range(k, k + n))
                    ids.add(name)
        expected[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert Counter(map(tuple, got)) == expected and sum(e[5] for e in expected) > 5


def test_op2(spark, folders):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got, rows = run(spark, folders, "op2_sentencepiece", "doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip")
    ids = lambda t: np.array(sp.encode(t or ""), "<u4").tobytes()
    assert Counter(map(tuple, got)) == Counter((i, len(ids(t)) // 4, zlib.crc32(ids(t)), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t, *_ in rows["documents"])


def test_op3(spark, folders):
    got, rows = run(spark, folders, "op3_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    norm = lambda t: (t or "").translate(LOWER)
    size, keep = Counter(norm(t) for _, t, *_ in rows["documents"]), {}
    for i, t, *_ in rows["documents"]:
        keep[norm(t)] = max(keep.get(norm(t), -1), i)
    assert Counter(map(tuple, got)) == Counter((i, keep[norm(t)], size[norm(t)], i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows["documents"])


def test_op4(spark, folders):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, rows = run(spark, folders, "op4_token_files", "doc_id", "start", "n_tokens", "ids_crc32")
    raw = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    expected, at = [], 0
    for i, text, *_ in sorted(rows["documents"], key=lambda r: r[0]):
        expected.append((i, at, len(raw(text)) // 4, zlib.crc32(raw(text))))
        at += expected[-1][2]
    assert sorted(map(tuple, got)) == sorted(expected)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op5(spark, folders):
    got, rows = run(spark, folders, "op5_lm_scoring", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").translate(LOWER).encode()), None]
    c = Counter(x for i, t, *_ in rows["documents"] if fold(i, 10) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
    by = Counter((i, fold(i, 10) == 0, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(base(t), 5)) for i, t, *_ in rows["documents"])
    assert Counter((*r[:5], round(r[5], 5)) for r in got) == by
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got) and {r["held_out"] for r in got} == {True, False}


def test_op6(spark, folders):
    got, rows = run(spark, folders, "op6_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    keep = {}
    for i, _, h in rows["pages"]:
        keep[h or ""] = max(keep.get(h or "", -1), i)
    sha = lambda h: b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter(map(tuple, got)) == Counter((i, len((h or "").encode()), sha(h), "response" if keep[h or ""] == i else "revisit", None if keep[h or ""] == i else keep[h or ""]) for i, _, h in rows["pages"])


def test_op7(spark, folders):
    from tests.llm.test_dedup import brute_components

    got, rows = run(spark, folders, "op7_near_dedup", "doc_id", "n_shingles", "component_id", "kept")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components([r[:2] for r in rows["documents"]], 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op8(spark, folders):
    got, rows = run(spark, folders, "op8_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows["documents"])
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "xx", "und") for r in got)
    real = {r[0]: r[2] for r in rows["documents"][:160]}
    held = [r["lang_pred"] == real[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in real]
    assert len(held) > 30 and sum(held) >= 0.95 * len(held)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {400, 401, 402, 404}


def test_op9(spark, folders):
    got, rows = run(spark, folders, "op9_html_text", "page_id", "url", "text", "n_chars")
    expected = {(k, f"http://h{k % 3}.example/{k}", f"Title {k // 2 * 2}\n\nSome & text {k // 2 * 2}") for k in range(20)} | {(50, None, ""), (51, "u", ""), (52, "http://h1.example/l", ("long text " * 50_000).strip())}
    assert {tuple(r)[:3] for r in got} == expected and all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(rows["pages"])


def test_op10(spark, folders):
    got, rows = run(spark, folders, "op10_quality", "doc_id", "held_out", "score", "predicted")
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows["documents"])
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    real = dict(r[:2] for r in rows["labels"] if r[0] is not None and r[1] is not None)
    held = [r["predicted"] == real[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in real]
    assert len(held) > 20 and sum(held) >= 0.9 * len(held)
