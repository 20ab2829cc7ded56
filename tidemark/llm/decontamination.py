"""Benchmark decontamination by Wu-Manber search over words.

A window is WINDOW consecutive words of a benchmark item, or the whole item if
it has fewer. For each window length there is a table of shifts by block (the
last two words under the cursor): a block that no window ends with moves the
cursor on by as many words as no window can end in. Only where a shift is zero
the bucket of that suffix is looked at: its windows are compared word by word,
or, if there are many, only those of the same words before the suffix.

The tables are built by tasks, in blocks of bounded bytes, and written to the
shared folder. A worker keeps those of KEPT_BLOCKS. A larger benchmark takes
tables of fixed size instead, however many windows it has: an array of shifts by
the block's hash and one bit for each suffix hash. What passes both, few windows of
few texts, is joined with the benchmark's windows by their words, which confirms it.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import fresh_path, mix64, slices, small, staged, text_bytes, unlike, word_hashes
from tidemark.llm.files import read_file, write_file

WINDOW = 13
#: Bytes of benchmark texts whose tables are in one block (some 100 bytes of tables for each), and blocks that a worker keeps.
BLOCK_BYTES, KEPT_BLOCKS = 1 << 20, 2
#: Bytes of document texts that are searched at once.
GROUP_BYTES = 1 << 19
#: Entries of a table of shifts, and bits of one of suffix hashes at least and at most: 16 for each window in between.
SHIFTS, LEAST_BITS, MOST_BITS = 1 << 20, 1 << 16, 1 << 27
#: Texts with hits that are broadcast; more are joined by shuffle.
FEW_TEXTS = 100_000
#: Windows of a bucket that are compared one after the other; in larger ones they are looked up by the words before the suffix.
FEW = 4

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Tables by file, in a worker.
_LOADED: dict = {}


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class WordSearch:
    """Wu-Manber tables for patterns of one length, given as {words: item ids}."""

    def __init__(self, length: int, patterns: dict[tuple, set]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list | dict] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = b" ".join(pattern[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(block, []).append((list(pattern), items))
        for block, bucket in self.buckets.items():
            if len(bucket) > FEW:
                self.buckets[block] = {tuple(pattern[: -self.block]): (pattern, items) for pattern, items in bucket}

    def find(self, text: list[bytes]):
        """(end, items) of each occurrence in text, in order."""
        length, far, shift, two = self.length, self.far, self.shift, self.block == 2
        at, n = length - 1, len(text)
        while at < n:
            block = text[at - 1] + b" " + text[at] if two else text[at]
            step = shift.get(block, far)
            if step:
                at += step
                continue
            first = at - length + 1
            bucket = self.buckets[block]
            if isinstance(bucket, dict):
                found = bucket.get(tuple(text[first : at - self.block + 1]))
                bucket = (found,) if found else ()
            for pattern, items in bucket:
                if text[first] == pattern[0] and text[first : at + 1] == pattern:
                    yield at, items
            at += 1


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WordSearch]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if size else ():
            by_length.setdefault(size, {}).setdefault(tuple(w[k : k + size]), set()).add(item)
    return [WordSearch(size, patterns) for size, patterns in sorted(by_length.items())]


def _tables(folder: str, window: int, limit: int):
    """Files of tables for at most limit bytes of items each, or for one item."""

    def run(batches):
        some, held = [], 0

        def close():
            name = write_file(folder, "tables", ".bin", pickle.dumps(build(some, window), pickle.HIGHEST_PROTOCOL))
            some.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size = len((text or "").encode()) + 64
                if some and held + size > limit:
                    yield close()
                    held = 0
                some.append((item, text))
                held += size
        if some:
            yield close()

    return run


def _loaded(folder: str, files: list[str]):
    """The tables of each file, of which a worker keeps those of one search from task to task."""
    for file in files:
        tables = _LOADED.get((folder, file))
        if tables is None:
            if len(_LOADED) >= 2 * KEPT_BLOCKS or any(other != folder for other, _ in _LOADED):
                _LOADED.clear()
            tables = _LOADED[folder, file] = pickle.loads(read_file(folder, file))
        yield tables


def _search(folder: str, files: list[str], keep: list[str], clean_only: bool, text_col: str):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 4096, GROUP_BYTES)):
            texts = [words(t) for t in batch.column(text_col).to_pylist()]
            marks: list[bytearray | None] = [None] * len(texts)
            items: list[set] = [set() for _ in texts]
            for tables in _loaded(folder, files):
                for k, w in enumerate(texts):
                    for table in tables:
                        for at, names in table.find(w):
                            if marks[k] is None:
                                marks[k] = bytearray(len(w))
                            marks[k][at - table.length + 1 : at + 1] = b"\1" * table.length
                            items[k] |= names
            sizes, hits = [len(w) for w in texts], [sum(m) if m else 0 for m in marks]
            bad = [h > 0 and 20 * h >= n for h, n in zip(hits, sizes, strict=True)]
            columns = [batch.column(c) for c in keep]
            if clean_only:
                yield pa.RecordBatch.from_arrays(columns, keep).filter(pa.array([not b for b in bad]))
                continue
            names = [sorted(x) for x in items]
            sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            out = [pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sums), pa.array(bad, pa.bool_()), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *out], [*keep, *(f.name for f in _RESULT)])

    return run


_RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    clean_only: bool = False,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """What each document shares with a benchmark; one row per row of docs, without a shuffle.

    Returns the columns ``keep`` of docs (all unless given), then n_words,
    n_hit (words inside an occurrence of any window), n_items and items (sorted
    ids of items with an occurring window), items_sha256 (of those ids, joined
    by commas) and contaminated (at least a twentieth of the words is hit).
    With clean_only the rows that are not contaminated, with the columns
    ``keep`` alone.

    A null or empty text has no words and is clean; an item without words has
    no window; a null item_id counts as the id "null"; repeated items are one.
    An empty benchmark leaves all documents clean. Rows that repeat a document
    have equal results, an empty table gives an empty one, a text of any length
    is read whole. A kept column with the name of a result gives way to it;
    further columns of either table are not read. The benchmark's tables are
    files of at most block_bytes of items each; of more than KEPT_BLOCKS of them
    see ``_by_filter``, which takes a second pass over the rows and shuffles
    the windows that may occur.
    """
    keep = unlike(docs.columns if keep is None else keep, [] if clean_only else [f.name for f in _RESULT])
    fields = {f.name: f for f in docs.schema.fields}
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    if int(total) > KEPT_BLOCKS * block_bytes:
        return _by_filter(docs, items, keep, window, clean_only, text_col)
    folder = fresh_path(spark, "tables")
    made = items.repartition(max(1, -(-int(total) // block_bytes))).mapInArrow(_tables(folder, window, block_bytes), "file string")
    files = sorted(r["file"] for r in staged(made, "blocks").collect())  # one short name for each block
    schema = T.StructType([fields[c] for c in keep] + ([] if clean_only else _RESULT))
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(_search(folder, files, keep, clean_only, text_col), schema)


# --- a benchmark of any size: tables of fixed size, and a join for what passes them

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes of many texts with spaces between, their hashes, and where each text's words begin among these."""
    data, offsets = text_bytes(column)
    clean = np.frombuffer(data.tobytes().translate(_WORD_BYTES), np.uint8)
    return clean, *word_hashes(clean, offsets)


def _suffixes(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hash of the block that ends there, and of the window; those before a text's length-th word mean nothing."""
    with np.errstate(over="ignore"):
        before = np.concatenate([[np.uint64(0)], hashes[:-1]]) if len(hashes) else hashes
        block = mix64(hashes + before * _BASE) if length > 1 else mix64(hashes)
        whole = np.zeros(len(hashes), np.uint64)
        for k in range(length - 1, -1, -1):
            whole = whole * _BASE + np.concatenate([np.zeros(min(k, len(hashes)), np.uint64), hashes[: max(0, len(hashes) - k)]])
    return block, mix64(whole)


def _windows(window: int):
    """(item, length, window) of all items' windows, the words with spaces between."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1024, 1 << 20)):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text)
                n = min(window, len(w))
                rows += [(item, n, b" ".join(w[k : k + n]).decode()) for k in range(len(w) - n + 1)] if n else []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.int32(), pa.string()), strict=True)], ["item", "length", "window"])

    return run


_FILTER = "length int, part int, shifts binary, bits binary"


def _filters(sizes: dict[int, int]):
    """A task's tables by length, of its windows."""

    def run(batches):
        from pyspark import TaskContext

        made: dict[int, tuple] = {}
        for batch in batches:
            lengths = np.array(batch.column("length").to_pylist(), int)
            _, hashes, first = _hashed(batch.column("window"))
            for n in np.unique(lengths).tolist():
                shifts, bits = made.setdefault(n, (np.full(SHIFTS, max(1, n - 1), np.uint8), np.zeros(sizes[n] // 8, np.uint8)))
                block, whole = _suffixes(hashes, n)
                ends = first[1:][lengths == n] - 1
                for back in range(max(1, n - 1)):  # the block that ends so many words before the window's end
                    np.minimum.at(shifts, (block[ends - back] % np.uint64(SHIFTS)).astype(np.int64), back)
                at = (whole[ends] % np.uint64(sizes[n])).astype(np.int64)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        part = TaskContext.get().partitionId() % 16
        yield pa.RecordBatch.from_arrays([pa.array([f(n, t) for n, t in made.items()], k) for f, k in ((lambda n, t: n, pa.int32()), (lambda n, t: part, pa.int32()), (lambda n, t: t[0].tobytes(), pa.binary()), (lambda n, t: t[1].tobytes(), pa.binary()))], ["length", "part", "shifts", "bits"])

    return run


def _merged(batches):
    """Tables of equal length made one, a row at a time."""
    made: dict[int, list] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            n, part, shifts, bits = (c[k].as_py() for c in batch.columns)
            own = np.frombuffer(shifts, np.uint8), np.frombuffer(bits, np.uint8)
            made[n] = [np.minimum(made[n][0], own[0]), made[n][1] | own[1]] if n in made else list(own)
    for n, (shifts, bits) in made.items():
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([0], pa.int32()), pa.array([shifts.tobytes()]), pa.array([bits.tobytes()])], ["length", "part", "shifts", "bits"])


def _key(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    from xxhash import xxh3_128_digest

    return [xxh3_128_digest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _may_occur(sent, text_col: str):
    """(text, last, length, window): windows of texts whose last block has no shift and whose hash has its bit."""

    def run(batches):
        tables = {n: (np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) for n, (a, b) in sent.value.items()}
        for batch in (part for whole in batches for part in slices(whole, 4096, GROUP_BYTES)):
            data, offsets = text_bytes(batch.column(text_col))
            clean, hashes, first = _hashed(batch.column(text_col))
            word = clean != 32
            opens = np.zeros(len(clean) + 1, bool)
            opens[offsets] = True
            begins = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]])[: len(word)] | word & opens[:-1])
            keys, rows = None, []
            for n, (shifts, bits) in tables.items():
                block, whole = _suffixes(hashes, n)
                ends = np.flatnonzero(shifts[(block % np.uint64(SHIFTS)).astype(np.int64)] == 0)
                at = (whole[ends] % np.uint64(8 * len(bits))).astype(np.int64)
                ends = ends[(bits[at >> 3] >> (at & 7)) & 1 == 1]
                text = np.searchsorted(first, ends, "right") - 1
                inside = ends - first[text] >= n - 1
                for end, k in zip(ends[inside].tolist(), text[inside].tolist(), strict=True):
                    keys = keys or _key(data, offsets)
                    stop = begins[end + 1] if end + 1 < first[k + 1] else offsets[k + 1]
                    rows.append((keys[k], end - int(first[k]), n, b" ".join(clean[begins[end - n + 1] : stop].tobytes().split()).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), (pa.binary(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["text", "last", "length", "window"])

    return run


def _counted(keep: list[str], text_col: str):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 4096, GROUP_BYTES)):
            column = batch.column(text_col)
            _, _, first = _hashed(column)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(_key(*text_bytes(column)), pa.binary()), pa.array(np.diff(first))], [*[f"k_{c}" for c in keep], "text", "n_words"])

    return run


def _by_filter(docs: DataFrame, items: DataFrame, keep: list[str], window: int, clean_only: bool, text_col: str) -> DataFrame:
    """``search`` for a benchmark of any size.

    The tables of shifts and bits have a fixed size for each length of windows,
    of which there are ``window`` at most; they are broadcast. Texts are told by a
    128-bit hash, so that copies are confirmed once.
    """
    spark = docs.sparkSession
    windows = staged(items.mapInArrow(_windows(window), "item string, length int, window string").distinct(), "windows")
    counts = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}  # one row a length
    sizes = {n: min(MOST_BITS, max(LEAST_BITS, 1 << int(16 * c - 1).bit_length())) for n, c in counts.items()}
    made = windows.select("length", "window").mapInArrow(_filters(sizes), _FILTER)
    made = staged(made, "filters").repartition(16, "part").mapInArrow(_merged, _FILTER).repartition(max(1, len(counts)), "length").mapInArrow(_merged, _FILTER)
    sent = spark.sparkContext.broadcast({r["length"]: (bytes(r["shifts"]), bytes(r["bits"])) for r in made.collect()})

    found = docs.select(F.col(text_col).alias("t")).mapInArrow(_may_occur(sent, "t"), "text binary, last long, length int, window string")
    found = staged(found.distinct(), "found")
    sure = staged(found.join(windows.select("length", "window").distinct(), ["length", "window"]), "hits")
    last = Window.partitionBy("text").orderBy(F.col("last") - F.col("length"), "last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("last") - F.greatest(F.coalesce(F.max("last").over(last), F.lit(-1)), F.col("last") - F.col("length"))
    hits = sure.select("text", F.greatest(new, F.lit(0)).alias("new")).groupBy("text").agg(F.sum("new").alias("n_hit"))
    names = sure.select("text", "length", "window").distinct().join(windows, ["length", "window"]).groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = small(staged(hits.join(names, "text"), "texts"), FEW_TEXTS)

    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*[T.StructField(f"k_{c}", fields[c].dataType) for c in keep], T.StructField("text", T.BinaryType()), T.StructField("n_words", T.LongType())])
    rows = docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(_counted(keep, text_col), schema).join(both, "text", "left")
    n_hit, own = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    bad = (n_hit > 0) & (20 * n_hit >= F.col("n_words"))
    kept = [F.col(f"k_{c}").alias(c) for c in keep]
    if clean_only:
        return rows.filter(~bad).select(*kept)
    return rows.select(*kept, "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), bad.alias("contaminated"), own.alias("items"))
