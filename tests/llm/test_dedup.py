"""Exact and near deduplication and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import decontamination, exact_dedup, near_dedup
from tidemark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = "doc_id long, text string, digest string, keep_id int, bucket int"


def make(spark, rows):
    """A documents table with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], ROWS)


def corpus(seed=3):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdeé") for _ in range(g.randint(1, 4)))
    texts = [" ".join(word() for _ in range(g.randint(8, 80))) for _ in range(40)]
    base = [word() for _ in range(120)]
    for _ in range(40):  # near copies of one text
        own = list(base)
        for _ in range(g.randint(0, 3)):
            own[g.randrange(len(own))] = word()
        texts.append(" ".join(own))
    core = [word() for _ in range(60)]
    texts += [" ".join(core + [word() for _ in range(5)]) for _ in range(30)]  # alike, but not enough
    texts += [texts[0].upper(), texts[0], texts[0]] * 5 + ["", "  \n", "one two", "one two", "One  two\t", "x " * 3000]
    rows = list(enumerate(texts))
    g.shuffle(rows)
    return rows + [(1000, None), (1001, None), (None, texts[1]), (None, None), (5, texts[5]), (5, texts[5])]


def test_exact_groups(spark):
    rows = corpus()
    got = exact_dedup.exact_groups(make(spark, rows).repartition(3), hitters=4).collect()
    norm = lambda t: (t or "").translate(LOWER)
    size, keep = Counter(norm(t) for _, t in rows), {}
    for i, t in rows:
        keep[norm(t)] = max((x for x in (keep.get(norm(t)), i) if x is not None), default=None)
    expected = Counter((i, keep[norm(t)], size[norm(t)], i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == expected
    left = exact_dedup.drop_copies(make(spark, rows))
    assert left.columns == ["doc_id", "text", "digest", "keep_id", "bucket"]
    assert Counter(norm(r["text"]) for r in left.collect()).keys() == size.keys()


def test_misra_gries_finds_every_heavy_key():
    g = random.Random(1)
    rows = [b"hot"] * 400 + [b"warm"] * 130 + [str(g.randrange(10**6)).encode() for _ in range(470)]
    g.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + 90], pa.binary())], ["digest"]) for k in range(0, 1000, 90)]
    out = next(exact_dedup.summarise(8, "digest")(iter(batches)))
    assert out.num_rows <= 8 and {b"hot", b"warm"} <= set(out.column("digest").to_pylist())


def brute_components(rows, percent):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return Counter(out)


@pytest.mark.parametrize("block", [1024, 8])
def test_near_groups(spark, block):
    rows = corpus()
    got = near_dedup.near_groups(make(spark, rows).repartition(3), 85, block=block).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_of_each_near_group_stays(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(80)) + (" tail" if k % 2 else " tale")) for k in range(9)] + [(20, "quite another text with enough words"), (21, None)]
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_copies(make(spark, rows), 80).collect()) == [0, 20, 21]


def test_estimate_is_near_the_truth():
    import numpy as np

    g = np.random.default_rng(0)
    common = g.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = (np.concatenate([common, g.integers(0, 2**63, 50, dtype=np.uint64)]) for _ in range(2))
    x, y = near_dedup.minima(a), near_dedup.minima(b)
    low = ((x & 15) == (y & 15)).mean()
    assert abs((low - 1 / 16) / (15 / 16) - 0.9) < 0.12 and near_dedup.floor_of(85) < 0.75


def test_components(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 201), (7, 7), (201, 202), (None, 3), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(101)} | {200: 200, 201: 200, 202: 200}


def test_empty_tables(spark):
    none = make(spark, []).limit(0)
    assert exact_dedup.exact_groups(none).count() == 0 and near_dedup.near_groups(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.search(make(spark, [(1, "a b")]), bench).first()["contaminated"] is False
    assert decontamination.search(none, bench).count() == 0


def test_decontamination(spark):
    g = random.Random(5)
    word = lambda: g.choice(["a", "b", "ab", "É", "x1"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([13, 13, 20, 40, 5, 2, 1, 0])] + [(8, None), (None, "q q q"), (3, "z z"), (9, "The, END!")]
    docs = []
    for k in range(60):
        w = [word() for _ in range(g.randint(0, 300))]
        for _, t in g.sample(items, 2):
            at = g.randint(0, len(w))
            w[at:at] = (t or "").upper().split()
        docs.append((k, ", ".join(w) if k % 2 else "\n".join(w)))
    docs += [(100, None), (101, ""), (100, docs[1][1]), (102, "END... the end")]
    found = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: found.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    expected = []
    for i, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= own
        expected.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 100):
        got = decontamination.search(make(spark, docs), bench, keep=["doc_id"], block_bytes=block_bytes)
        assert Counter(tuple(r)[:6] for r in got.collect()) == Counter(expected)
        clean = decontamination.search(make(spark, docs), bench, clean_only=True, block_bytes=block_bytes)
        assert clean.columns == ["doc_id", "text", "digest", "keep_id", "bucket"] and clean.count() == sum(not e[5] for e in expected)
    named = make(spark, docs).withColumnsRenamed({"digest": "N_hit", "bucket": "_hit", "keep_id": "_Items"})
    got = decontamination.search(named, bench, block_bytes=100)
    assert got.columns == ["doc_id", "text", "_Items", "_hit", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
    assert Counter((r["doc_id"], *r[4:9]) for r in got.collect()) == Counter(expected)


def test_a_bucket_of_many_windows_is_not_read_through():
    import time

    def took(n):
        items = [(str(k), f"a{k} b{k} the same end") for k in range(n)]
        (table,) = decontamination.build(items)
        text = decontamination.words("x y the same end " * 4000)
        began = time.perf_counter()
        assert not list(table.find(text))
        assert [names for _, names in table.find(decontamination.words("z a7 b7 the same end"))] == [{"7"}]
        return time.perf_counter() - began

    assert took(20_000) < 20 * took(20) + 0.2


def test_a_very_long_text_is_searched_whole(spark):
    text = "filler words " * 400_000 + "the item of nine words is at the end"
    bench = spark.createDataFrame([("i", "The item of nine words is at the end")], "item_id string, text string")
    for block_bytes in (1 << 20, 10):
        r = decontamination.search(make(spark, [(1, text)]), bench, block_bytes=block_bytes).first()
        assert (r["n_words"], r["n_hit"], r["items"]) == (800_009, 9, ["i"])


def test_tables_of_fixed_size_pass_few_windows_that_do_not_occur():
    import numpy as np
    import pyarrow as pa

    g = random.Random(4)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(4))
    windows = [" ".join(word() for _ in range(13)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"length": pa.array([13] * 3000, pa.int32()), "window": windows})
    sizes = {13: 1 << 16}
    from unittest import mock

    with mock.patch("pyspark.TaskContext.get") as get:
        get.return_value.partitionId.return_value = 0
        halves = [next(decontamination._filters(sizes)([part])) for part in (batch.slice(0, 1000), batch.slice(1000))]
    (merged,) = decontamination._merged(halves)
    shifts, bits = (np.frombuffer(merged.column(c)[0].as_py(), np.uint8) for c in ("shifts", "bits"))
    assert shifts.min() == 0 and (shifts == 12).mean() > 0.9 and len(bits) * 8 == 1 << 16
    texts = [windows[7], " ".join(word() for _ in range(20_000)), "x " + windows[2999].upper() + ", y"]

    class Sent:
        value = {13: (shifts.tobytes(), bits.tobytes())}

    (out,) = decontamination._may_occur(Sent, "t")([pa.RecordBatch.from_pydict({"t": texts})])
    found = out.column("window").to_pylist()
    assert {windows[7], windows[2999]} <= set(found) and len(found) < 40


def test_one_row_of_each_group_is_left(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (1, long.upper()), (2, long), (None, "null ids of five words here"), (None, "null ids of five words here"), (7, ""), (7, ""), (8, None)]
    docs = make(spark, rows).repartition(3)
    norm = lambda r: (r["doc_id"], (r["text"] or "").translate(LOWER))
    left = [norm(r) for r in exact_dedup.drop_copies(docs).collect()]
    assert Counter(left) == Counter([(2, long), (None, rows[4][1]), (8, "")])
    left = [norm(r) for r in near_dedup.drop_near_copies(docs).collect()]
    assert Counter(left) == Counter([(1, long), (None, rows[4][1]), (7, ""), (7, ""), (8, "")])


def test_a_very_long_text_among_near_copies(spark):
    g = random.Random(4)
    words = [f"w{g.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3])), (3, " ".join(words[:120_000])), (4, "x" * 2_000_000), (5, "x" * 2_000_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(make(spark, rows)).collect()}
    assert got == {1: (149_996, 1), 2: (149_993, 1), 3: (119_996, 3), 4: (1, 4), 5: (1, 4)}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.llm.common import shared_dir

    context = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(context(master))


def test_slices_are_bounded_by_bytes():
    from tidemark.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 100, None, "y" * 5000, "z", "z" * 60], "n": [1, 2, 3, 4, 5]})
    parts = list(slices(batch, 4, 200))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert [p.num_rows for p in slices(batch, 2)] == [2, 2, 1] and not list(slices(batch.slice(0, 0)))


def test_dropping_copies_keeps_columns_of_any_name(spark):
    docs = make(spark, corpus()).withColumnsRenamed({"digest": "_gone", "bucket": "_KEY"})
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        kept = drop(docs)
        assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
