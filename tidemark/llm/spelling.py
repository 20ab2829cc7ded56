"""Spelling variant grouping over forward and reversed sorted dictionaries.

One edit leaves one half of a word intact. So each word stands in the forward
dictionary, sorted by its first half, and in the reversed one, sorted by its last half
from the end; two words that are one edit apart share a block of one of them. A
block is a range of the sorted dictionary: tasks scan their ranges and compare
the words of a block. Blocks with more than BLOCK words are subdivided before
that, by the half of what is left between what their words share, until at the finest
only one place is open, where as many words can stand as there are letters.

Words of m code points are compared with one another (one code point
replaced) and with those of m + 1 (one inserted), each in blocks of its own. A
block stands for a range of places at which its pairs may first differ, the two
blocks that it is divided into for the two halves of this range. So each pair is
found in one block alone, and nothing is found twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, small, staged

LEAST_LETTERS, LEAST_COUNT, DROP_ONE_IN = 5, 3, 97
#: Words of a block that are compared with one another; larger blocks are subdivided.
BLOCK = 128
#: Words or keys of blocks that are broadcast, some 20 MB; more are shuffled.
FEW_ROWS = 200_000
#: Distinct words that a task counts before it passes them on, rows that a scan takes up at once, and code points that it compares at once.
HELD_WORDS, SCAN_ROWS, SCAN_CELLS = 400_000, 50_000, 1 << 22

_RUN, _BREAK = re.compile("[a-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_PIECE = 1 << 20


def _runs(text: str) -> Counter:
    """How often each run of letters is in a text, A-Z lower-cased."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        gap = _BREAK.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = gap.end() if gap else len(text)
        found.update(_RUN.findall(text[at:end].encode().lower().decode()))  # of bytes, lower() takes A-Z alone
        at = end
    return found


def _count(least: int, one_in: int):
    def run(batches):
        held: dict[str, int] = {}

        def close():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole)):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in _runs(text or "").items():
                    if one_in:
                        h = zlib.crc32(word.encode(), start)
                        if h % one_in == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield close()
        yield close()

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): runs of letters of all texts with at least so many code points and occurrences, A-Z lower-cased.

    With drop_one_in, the runs of a document whose crc32 of ``<doc_id>:<run>``
    is divisible by it lose one code point (a planted misspelling); 0 changes none.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_count(least_letters, drop_one_in), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- blocks of the two dictionaries

#: kind: R for words of m code points, I for those and words of m + 1; m; from, to: where a pair of the block may first differ.
_AT = ["kind", "m", "from", "to"]


def _named(rows: DataFrame) -> DataFrame:
    """rows with ``key``: what the words of a block share, first its kind and place.

    Before ``from`` the words of a block are equal, and after the place that
    differs, at most ``to`` - 1, again: the last m - to code points, m + 1 - to
    where one is inserted. The shared end is reversed, as the dictionary is.
    """
    tail = F.col("m") - F.col("to") + (F.col("kind") == "I").cast("int")
    shared = F.concat(F.substring("word", F.lit(1), F.col("from")), F.lit(" "), F.reverse(F.expr("right(word, tail)")))
    head = F.concat_ws(" ", F.col("kind"), F.lpad(F.col("m").cast("string"), 7, "0"), F.lpad(F.col("from").cast("string"), 7, "0"), F.lpad(F.col("to").cast("string"), 7, "0"))
    return rows.withColumn("tail", F.greatest(tail, F.lit(0))).withColumn("key", F.concat(head, F.lit(" "), shared)).drop("tail")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row for the two halves of its range: the block of the forward and of the reversed dictionary."""
    middle = ((F.col("from") + F.col("to")) / 2).cast("int")
    ways = F.array(F.struct(middle.alias("from"), F.col("to").alias("to")), F.struct(F.col("from").alias("from"), middle.alias("to")))
    others = [c for c in rows.columns if c not in ("from", "to", "key")]
    return _named(rows.select(*others, F.explode(ways).alias("way")).select(*others, "way.from", "way.to"))


def blocks(words: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """(word, n, kind, m, from, to, key), one table for each depth of subdivision; no key has more than block rows but those of one open place."""
    size = F.length("word")
    roles = F.array(
        F.struct(F.lit("R").alias("kind"), size.alias("m"), size.alias("to")),
        F.struct(F.lit("I").alias("kind"), size.alias("m"), (size + 1).alias("to")),
        F.struct(F.lit("I").alias("kind"), (size - 1).alias("m"), size.alias("to")),
    )
    rows = words.select("word", "n", F.explode(roles).alias("role")).filter("role.m > 0")
    rows = _halves(rows.select("word", "n", "role.kind", "role.m", F.lit(0).alias("from"), "role.to"))
    out = []
    while True:
        rows = staged(rows, "blocks")
        large = staged(rows.filter(F.col("to") - F.col("from") > 1).groupBy("key").count().filter(F.col("count") > block).select("key"), "large")
        if large.isEmpty():
            return [*out, rows]
        large = small(large, FEW_ROWS)
        out.append(rows.join(large, "key", "left_anti"))
        rows = _halves(rows.join(large, "key", "left_semi"))


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points by word and place, 0 beyond a word's end."""
    raw = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le")
    return np.frombuffer(raw, np.uint32).reshape(len(words), width)


def _near(kind: str, m: int, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart and first differ from low to high - 1; for I, left are words of m code points, right of m + 1."""
    unlike = left[:, :m] != right[:, :m]
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), m)
    inside = (first >= low) & (first < high)
    if kind == "R":
        return inside & (unlike.sum(axis=1) == 1)
    after = (left[:, :m] != right[:, 1 : m + 1]) & (np.arange(m) >= first[:, None])
    return inside & ~after.any(axis=1)


def _scanned(table: pa.Table):
    """Both directions of all near pairs of whole blocks, as arrays of (word, near, near_n)."""
    names, sizes = table["word"].to_pylist(), table["n"].to_pylist()
    m, low, high = (table[c].to_numpy() for c in ("m", "from", "to"))
    keys = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    kinds = table["kind"].to_pylist()
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
    rows = np.diff(edges)
    # kinds and lengths stand together in key order, so each is one range of blocks
    marks = [(kinds[e], int(m[e])) for e in edges[:-1].tolist()]
    at = 0
    while at < len(marks):
        end = at
        while end < len(marks) and marks[end] == marks[at]:
            end += 1
        kind, width = marks[at]
        first, last = int(edges[at]), int(edges[end])
        codes = _codes(names[first:last], width + 1)
        long = np.fromiter((len(w) > width for w in names[first:last]), bool, last - first)
        stop = np.repeat(edges[at + 1 : end + 1], rows[at:end]) - first
        open_ = np.arange(last - first)
        for step in range(1, int(rows[at:end].max())):
            open_ = open_[open_ + step < stop[open_]]
            i = open_[long[open_] != long[open_ + step]] if kind == "I" else open_
            for some in np.array_split(i, 1 + len(i) * (width + 1) // SCAN_CELLS) if len(i) else ():
                a, b = some, some + step
                if kind == "I":  # the shorter word first
                    a, b = np.where(long[a], b, a), np.where(long[a], a, b)
                good = np.flatnonzero(_near(kind, width, low[first + some], high[first + some], codes[a], codes[b]))
                for x, y in zip((a[good] + first).tolist(), (b[good] + first).tolist(), strict=True):
                    yield names[x], names[y], sizes[y]
                    yield names[y], names[x], sizes[x]
        at = end


def _scan(batches):
    """Near pairs of a range of the sorted dictionary, whole blocks at a time."""

    def found(table: pa.Table):
        rows = list(_scanned(table))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

    held: list[pa.Table] = []
    for batch in (part for whole in batches for part in slices(whole, SCAN_ROWS, 8 << 20)):
        held.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(held)
        if table.num_rows < SCAN_ROWS and table.nbytes < 8 << 20:
            continue
        keys = table["key"].to_pylist()
        cut = len(keys)
        while cut and keys[cut - 1] == keys[-1]:  # the last block may go on
            cut -= 1
        if cut:
            yield found(table.slice(0, cut))
        held = [table.slice(cut)]
    if held:
        yield found(pa.concat_tables(held))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of all words (word, n) that are one inserted, deleted or replaced code point apart, in both directions."""
    out = None
    for rows in blocks(words, block):
        pairs = rows.select("key", "word", "n", "kind", "m", "from", "to").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_scan, "word string, near string, near_n long")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: forms are followed to the last, twice as far each time.

    A form has at least twice its word's occurrences, so chains are short.
    """
    reach = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = staged(reach.join(small(on, FEW_ROWS), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.filter("moved").isEmpty():
            return further.select("word", "root")
        reach = further.select("word", "root")


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """The spelling that each word of (word, n) is a variant of.

    Two words are near if one is the other with one code point inserted,
    deleted or replaced. A word's form is its near word with the largest n (of
    several the first in code-point order) if that n is at least twice its own, else
    null. Returns word, form, root (where following forms from word ends; the word
    itself without a form), n, n_near (how many near words it has) and form_n.

    words has each word once; null and empty words have no place in it. An empty
    table gives an empty result. A word of any length is compared whole.
    """
    words = staged(words.select("word", "n").filter("word <> ''"), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    good = F.col("best.near_n") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("best.near_n")).alias("form_n"))
    found = staged(found, "forms")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    drop_one_in: int = DROP_ONE_IN,
    block: int = BLOCK,
) -> DataFrame:
    """``variants`` of the words of all documents (``count_words``): word, form, root, n, n_near, form_n.

    A null text has no words, a null doc_id counts as "null"; rows that repeat
    a document add their occurrences. An empty table gives an empty result; a
    text of any length is read whole, a piece at a time; other columns are not read.
    """
    return variants(count_words(docs, id_col, text_col, least_letters, least_count, drop_one_in), block)
