"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Tokens are words and one end mark a text. Unigram and bigram counts of the
training texts are quantised on a logarithmic scale, and an n-gram of level q
is put into a Bloom filter q times, once for each level up to its own; a count
is read back by probing level after level until one is missing. The filter is
made in buckets by hash, as many as the texts' bytes ask for. It is broadcast
if it is one block of bounded size; several blocks are files that a worker reads
in turn. A token's probability is a mean of the bigram and unigram shares so
read, in which the bigram weighs more the more often its context was seen, and
nothing where it never was.

Exact unigram counts stay in tables by bucket; they give the base scores. The
most frequent words, a bounded number, are broadcast; words that the filter does
not hold were never learned; the others are looked up by a shuffle on the bucket.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_words, fresh_path, mix64, slices, small, staged
from tidemark.llm.files import read_file, write_file

#: A level holds counts up to this factor apart.
LOG_BASE = 1.5
#: Filter bits for an entry and level; bits that one sets, all in one 64-bit word.
ENTRY_BITS, SET_BITS = 10, 4
#: The most that the bigram share weighs; after a context of c tokens it weighs c / (c + 1) of that.
BIGRAM_WEIGHT = 0.5
#: Added to each count of the base model.
ADDED = 0.1
#: Bytes of training text for each bucket of n-grams.
BUCKET_TEXT = 4 << 20
#: Bytes of filter that are broadcast, and that a task holds at once; a larger one is dealt out in files, by even ranges of buckets.
BLOCK_BYTES = 128 << 20
#: Bytes of text that a task probes one block for at once, and several blocks, which it reads again for each such group.
GROUP_BYTES = 1 << 20, 16 << 20
#: Bytes of words asked for that one call looks up; a bucket of more is dealt out over several.
ASKED_BYTES = 16 << 20
#: Words whose exact counts are broadcast (16 bytes each): the most frequent.
FREQUENT = 500_000
#: Tokens after which a task hands on what it has counted.
FLUSH = 1_000_000

_END, _START = np.uint64(0xA24BAED4963EE407), np.uint64(0x8CB92BA72F3D8DD7)
_LEVEL = np.uint64(0xD1342543DE82EF95)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end marks among them, and where each text's begin."""
    hashes, offsets = column_words(column)
    n = len(offsets) - 1
    edges = offsets + np.arange(n + 1)
    out = np.empty(len(hashes) + n, np.uint64)
    ends = edges[1:] - 1
    words = np.ones(len(out), bool)
    words[ends] = False
    out[words] = hashes
    out[ends] = _END
    return out, edges


def bigrams(t: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it, the first with a start mark."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[edges[:-1]] = _START
    return mix64(before * np.uint64(0x9E6C63D0876A9A47) + t)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts.astype(np.float64)) / math.log(LOG_BASE) + 1e-9).astype(np.int64)


def level_counts(most: int = 120) -> np.ndarray:
    """The count that each level stands for: the middle of the whole numbers in it, 0 for level 0."""
    q = np.arange(most)
    low, high = np.ceil(LOG_BASE**q - 1e-9), np.ceil(LOG_BASE ** (q + 1) - 1e-9) - 1
    return np.concatenate([[0.0], (low + np.maximum(low, high)) / 2])


def _places(h: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a bucket's filter, and the bits in it, for hashes at a level."""
    x = mix64(h + _LEVEL * np.asarray(level).astype(np.uint64))
    word = ((x >> np.uint64(32)) * np.asarray(size).astype(np.uint64)) >> np.uint64(32)
    bits = np.zeros(len(x), np.uint64)
    for k in range(SET_BITS):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return word.astype(np.int64), bits


def build_filter(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit words of one bucket's filter."""
    q = levels(counts)
    every = np.repeat(hashes, q)
    level = np.arange(len(every)) - np.repeat(np.cumsum(q) - q, q) + 1
    size = max(1, -(-len(every) * ENTRY_BITS // 64))
    word, bits = _places(every, level, size)
    order = np.argsort(word, kind="stable")
    word, bits = word[order], bits[order]
    out = np.zeros(size, np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(bits, first)
    return out


class Filter:
    """Filters of the buckets low <= bucket < high, of unigrams and bigrams, end to end."""

    def __init__(self, buckets: int, low: int, high: int, words: list[np.ndarray], starts: list[np.ndarray], sizes: list[np.ndarray]):
        self.buckets, self.low, self.high, self.words, self.starts, self.sizes = buckets, low, high, words, starts, sizes

    def fill(self, kind: int, x: np.ndarray, bucket: np.ndarray, out: np.ndarray) -> None:
        """Set out to the counts of those of the ascending hashes x whose bucket is in this block."""
        own = slice(*np.searchsorted(bucket, [self.low, self.high]))
        x, b = x[own], bucket[own] - self.low
        start, size = self.starts[kind][b], self.sizes[kind][b]
        level, live = np.zeros(len(x), np.int64), np.arange(len(x))
        for q in range(1, 120):
            word, bits = _places(x[live], q, size[live])
            live = live[(self.words[kind][start[live] + word] & bits) == bits]
            if not len(live):
                break
            level[live] = q
        out[own] = level_counts()[level]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are even ranges of hashes; buckets is a power of two."""
    return (h >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)


def _cut(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_of(sorted_hashes, buckets), np.arange(buckets + 1))


_COUNTED = "kind int, bucket int, hashes binary, counts binary"


def _count(buckets: int):
    def flush(kept: list[list[np.ndarray]]):
        for kind in (0, 1):
            h, n = np.unique(np.concatenate(kept[kind]), return_counts=True)
            cut = _cut(h, buckets)
            used = np.flatnonzero(np.diff(cut)).tolist()
            n = n.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(used), pa.int32()),
                    pa.array(used, pa.int32()),
                    pa.array([h[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
                    pa.array([_bytes_of(n[cut[b] : cut[b + 1]]) for b in used], pa.binary()),
                ],
                ["kind", "bucket", "hashes", "counts"],
            )

    def run(batches):
        kept: list[list[np.ndarray]] = [[], []]
        held = 0
        for whole in batches:
            for batch in slices(whole):
                with np.errstate(over="ignore"):
                    t, edges = tokens(batch.column("text"))
                    if len(edges) > 1:
                        kept[0].append(t)
                        kept[1].append(bigrams(t, edges))
                held += len(t)
                if held >= FLUSH:
                    yield from flush(kept)
                    kept, held = [[], []], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from flush(kept)

    return run


def _bytes_of(n: np.ndarray) -> bytes:
    """Counts as bytes where all are small, else as 32- or 64-bit integers, with the width before them."""
    kind = "u1" if n.max(initial=0) < 256 else "<u4" if n.max(initial=0) < 2**32 else "<u8"
    return bytes([np.dtype(kind).itemsize]) + n.astype(kind).tobytes()


def _counts_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([np.frombuffer(b, "<u8") for b in table.column("hashes").to_pylist()])
    n = np.concatenate([_counts_of(b) for b in table.column("counts").to_pylist()])
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first)


_MODEL = "kind int, bucket int, hashes binary, counts binary, filter binary, total long, n_distinct long, histogram array<long>"
#: Counts of a word are told apart up to this power of two when the frequent ones are chosen.
_POWERS = 48


def _reduce(table: pa.Table) -> pa.Table:
    """One bucket's exact counts (of unigrams) and filter, sums, and words by power of two of their count."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    with np.errstate(over="ignore"):
        h, n = _merged(table)
        built = build_filter(h, n)
    histogram = np.bincount(np.log2(n).astype(np.int64), minlength=_POWERS)
    words = kind == 0
    row = {"kind": kind, "bucket": bucket, "hashes": h.tobytes() if words else None, "counts": _bytes_of(n) if words else None, "filter": built.tobytes(), "total": int(n.sum()), "n_distinct": len(h), "histogram": histogram.tolist()}
    return pa.Table.from_pylist([row], pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary()), ("total", pa.int64()), ("n_distinct", pa.int64()), ("histogram", pa.list_(pa.int64()))]))


class Model:
    """What a training corpus gives: a table of buckets, and the sums over them."""

    def __init__(self, table: DataFrame, buckets: int, texts: int):
        self.table, self.buckets, self.texts = table, buckets, texts
        sums = table.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("n_distinct").alias("n"), F.sum(F.length("filter")).alias("bytes")).collect()
        by = {r["kind"]: r for r in sums}
        self.total, self.distinct = (by[0]["total"], by[0]["n"]) if 0 in by else (0, 0)
        self.bytes = sum(r["bytes"] for r in sums)


def _buckets(spark, size: int) -> int:
    """A power of two: some buckets for each shuffle partition, and so many that each has a bounded part of size bytes of text."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(6, (2 * parts - 1).bit_length(), (size // BUCKET_TEXT).bit_length())


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the unigrams and bigrams of all texts of docs (null: empty) and build the filter's buckets."""
    rows = docs.select(F.col(text_col).alias("text"))
    texts, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    buckets = _buckets(docs.sparkSession, size or 0)
    counted = rows.mapInArrow(_count(buckets), _COUNTED)
    table = staged(counted.groupBy("kind", "bucket").applyInArrow(_reduce, _MODEL), "lm")
    return Model(table, buckets, texts)


def _filter(buckets: int, low: int, high: int, sizes, rows) -> Filter:
    """The filter of a range of buckets from (kind, bucket, bytes of words) and (kind, bucket, words), which are read once each."""
    size = [np.ones(high - low, np.int64) for _ in (0, 1)]
    for kind, bucket, n in sizes:
        size[kind][bucket - low] = n // 8
    start = [np.cumsum(n) - n for n in size]
    words = [np.zeros(int(n.sum()), np.uint64) for n in size]
    for kind, bucket, blob in rows:
        at = int(start[kind][bucket - low])
        words[kind][at : at + len(blob) // 8] = np.frombuffer(blob, "<u8")
    return Filter(buckets, low, high, words, start, size)


def _write_block(folder: str, buckets: int, shift: int):
    def run(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "filter")), strict=True))
        made = _filter(buckets, k << shift, (k + 1) << shift, [(kind, bucket, len(x)) for kind, bucket, x in rows], rows)
        name = write_file(folder, "filter", ".bin", pickle.dumps(made, pickle.HIGHEST_PROTOCOL))
        return pa.table({"block": pa.array([k], pa.int32()), "file": [name]})

    return run


def _blocks(model: Model, limit: int) -> list:
    """The filter in blocks of about limit bytes: a broadcast if it is one, else (folder, file) of each."""
    spark = model.table.sparkSession
    rows = model.table.select("kind", "bucket", "filter")
    count = min(model.buckets, 1 << max(0, -(-model.bytes // limit) - 1).bit_length())
    if count == 1:
        sizes = rows.select("kind", "bucket", F.length("filter")).collect()
        return [spark.sparkContext.broadcast(_filter(model.buckets, 0, model.buckets, sizes, rows.toLocalIterator()))]
    shift = (model.buckets // count).bit_length() - 1
    folder = fresh_path(spark, "filter")
    made = rows.withColumn("block", F.shiftright("bucket", shift)).groupBy("block").applyInArrow(_write_block(folder, model.buckets, shift), "block int, file string")
    return [(folder, r["file"]) for r in staged(made, "blocks").orderBy("block").collect()]


def _frequent(limit_power: int):
    def run(batches):
        for batch in batches:
            for h, n in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                h, n = np.frombuffer(h, "<u8"), _counts_of(n)
                keep = n >= 1 << limit_power
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([n[keep].tobytes()], pa.binary())], ["hashes", "counts"])

    return run


def frequent_words(model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and exact counts of the words with at least 2^p tokens, p the least with at most ``most`` such words."""
    rows = model.table.filter("kind = 0")
    powers = np.zeros(_POWERS, np.int64)
    for k, n in rows.select(F.posexplode("histogram").alias("p", "n")).groupBy("p").agg(F.sum("n").alias("n")).collect():
        powers[k] = n
    above = powers[::-1].cumsum()[::-1]
    power = next((p for p in range(_POWERS) if above[p] <= most), _POWERS - 1)
    found = rows.select("hashes", "counts").mapInArrow(_frequent(power), "hashes binary, counts binary").toArrow()
    h = np.frombuffer(b"".join(found.column("hashes").to_pylist()), "<u8")
    n = np.frombuffer(b"".join(found.column("counts").to_pylist()), "<i8")
    order = np.argsort(h)
    return h[order], n[order]


def _groups(batches, limit: int):
    """Rows in tables of at least limit bytes of text, the last one aside."""
    some, held = [], 0
    for whole in batches:
        for batch in slices(whole, 256):
            some.append(batch)
            held += batch.nbytes
            if held >= limit:
                yield pa.Table.from_batches(some)
                some, held = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _values(blocks):
    """The filter's blocks one after the other; a worker keeps one only if there is no other."""
    for block in blocks:
        yield pickle.loads(read_file(*block)) if isinstance(block, tuple) else block.value


def probabilities(single: np.ndarray, double: np.ndarray, context: np.ndarray, base: tuple[float, float], weight: float = BIGRAM_WEIGHT) -> np.ndarray:
    """Of tokens, from their counts, those of the bigrams they end and those of what stands before them."""
    added, norm = base
    context = np.maximum(context, double)
    own = weight * context / (context + 1)
    return own * double / np.maximum(1.0, context) + (1 - own) * (single + added) / norm


def _probe(blocks, buckets: int, frequent, base: tuple[float, float, int], weight: float):
    """Scores of rows; of several blocks of the filter a task holds one at a time, for GROUP_BYTES of text each."""

    def run(batches):
        added, norm, texts = base
        for rows in _groups(batches, GROUP_BYTES[len(blocks) > 1]):
            if not rows.num_rows:
                continue
            with np.errstate(over="ignore"):
                t, edges = tokens(rows.column("text"))
                asked = [(x, back.astype(np.int32)) for x, back in (np.unique(h, return_inverse=True) for h in (t, bigrams(t, edges)))]
                bucket = [bucket_of(x, buckets) for x, _ in asked]
                counts = [np.zeros(len(x)) for x, _ in asked]
                for f in _values(blocks):
                    for kind in (0, 1):
                        f.fill(kind, asked[kind][0], bucket[kind], counts[kind])
            single, double = (n[back] for n, (_, back) in zip(counts, asked, strict=True))
            del asked, bucket, counts
            context = np.empty(len(t))
            context[1:] = single[:-1]
            context[edges[:-1]] = texts
            p = probabilities(single, double, context, (added, norm), weight)
            starts = edges[:-1]
            score = np.add.reduceat(np.log10(p), starts)
            h, n = frequent.value
            at = np.minimum(np.searchsorted(h, t), max(0, len(h) - 1))
            known = h[at] == t if len(h) else np.zeros(len(t), bool)
            asked = ~known & (single > 0)  # the filter misses nothing: what it does not hold has a count of 0
            logs = np.where(asked, 0.0, np.log10((np.where(known, n[at] if len(h) else 0, 0) + added) / norm))
            rest = [t[a:b][asked[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), pa.array(np.diff(edges)), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(logs, starts)), pa.array(score), pa.array(rest, pa.binary())],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "rest"],
            )

    return run


def _deal(buckets: int):
    """Words that are to be looked up, with their rows' numbers, by bucket."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 4096):
                blobs = batch.column("rest").to_pylist()
                h = np.frombuffer(b"".join(blobs), "<u8")
                row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64), [len(b) // 8 for b in blobs])
                order = np.argsort(h, kind="stable")
                h, row = h[order], row[order]
                cut = _cut(h, buckets)
                used = np.flatnonzero(np.diff(cut)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([h[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()), pa.array([row[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary())],
                    ["kind", "bucket", "hashes", "counts"],
                )

    return run


def _look_up(base: tuple[float, float, int]):
    added, norm, _ = base

    def run(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())
        h, n = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for k in np.flatnonzero(kinds == 0):
            words, counts = np.frombuffer(h[k], "<u8"), _counts_of(n[k])
        asked = [k for k in np.flatnonzero(kinds == 1)]
        x = np.concatenate([np.frombuffer(h[k], "<u8") for k in asked]) if asked else np.zeros(0, np.uint64)
        row = np.concatenate([np.frombuffer(n[k], "<i8") for k in asked]) if asked else np.zeros(0, np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, x), len(words) - 1)
            c = np.where(words[at] == x, counts[at], 0)
        else:
            c = np.zeros(len(x), np.int64)
        return pa.table({"row": pa.array(row, pa.int64()), "more_known": pa.array((c > 0).astype(np.int64)), "more_base": pa.array(np.log10((c + added) / norm), pa.float64())})

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", weight: float = BIGRAM_WEIGHT, block_bytes: int = BLOCK_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    score is log10 of the model's probability of the text, base_score that of
    the unigram model with ADDED added to exact counts (one more kind of word
    standing for all unknown ones). A null or empty text is its end mark alone.
    A model of no texts gives every token the same probability. Rows that
    repeat a doc_id are scored apart, an empty table gives an empty result, a
    text of any length is read whole; other columns are not read.
    """
    base = (ADDED, model.total + ADDED * (model.distinct + 1), model.texts)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_words(model, frequent))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = out.mapInArrow(_probe(_blocks(model, block_bytes), model.buckets, sent, base, weight), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rest binary")
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.filter(F.length("rest") > 0).select("row", "rest").mapInArrow(_deal(model.buckets), "kind int, bucket int, hashes binary, counts binary")
    asked = staged(asked, "asked")
    # a bucket that is asked for a lot, as one word may be, is dealt out over several calls, each with its counts
    parts = asked.groupBy("bucket").agg(F.ceil(F.sum(F.length("hashes")) / F.lit(ASKED_BYTES)).cast("int").alias("parts"))
    parts = small(staged(parts.filter("parts > 1"), "parts"))
    several = lambda rows: rows.join(parts, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = several(asked).withColumn("part", F.pmod(F.xxhash64("counts"), "parts").cast("int"))
    known = several(model.table.filter("kind = 0").select("kind", "bucket", "hashes", "counts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = asked.unionByName(known).drop("parts").groupBy("bucket", "part").applyInArrow(_look_up(base), "row long, more_known long, more_base double")
    more = found.groupBy("row").agg(F.sum("more_known").alias("more_known"), F.sum("more_base").alias("more_base"))
    both = scored.drop("rest").join(more, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("more_base")).alias("base_score"),
        "score",
    )
