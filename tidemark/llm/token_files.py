"""Token ids in binary files, in ascending document order.

A file holds the ids of consecutive documents. Ids are replaced by their rank
by frequency in the file, whose header lists the ids by rank, so that frequent
ids take one byte. Ranks are coded in one to four bytes; a separate stream of
control bytes holds four lengths each, two bits apiece, and is decoded by a
table of 256 rows without looking at one rank after the other.

Layout, little-endian: MAGIC, then five 64-bit integers (documents, ids,
distinct ids, bytes of data, 0), the distinct ids by rank (32 bits each), the
number of ids of each document (32 bits each), the control bytes, the data.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import fresh_path, slices, staged
from tidemark.llm.files import read_file, write_file

MAGIC = b"TIDEIDS1"
#: Ids after which a file is closed; one document may be longer.
FILE_IDS = 2_000_000
#: Words whose ids a worker remembers, and ids in them, about; later ones are encoded each time.
CACHE_WORDS, CACHE_IDS = 900_000, 8_000_000
#: Longer words are not remembered.
LONG_WORD = 40
#: Words that go to the library as one text.
JOINED_WORDS = 16_384
#: Rows and bytes of texts that are encoded at a time.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
#: Ids below this are counted and ranked by a table as long.
TABLE_IDS = 1 << 24

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of 32-bit unsigned integers, by byte-aligned variable-length code."""
    n = len(values)
    wide = _width(int(values.max(initial=0)))
    more = (values > 0xFF).view(np.uint8)
    if wide > 2:
        more = more + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros(-(-n // 4) * 4, np.uint8)
    four[:n] = more
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    parts = values.astype(f"<u{wide}").view(np.uint8).reshape(n, wide)
    return control.tobytes(), parts[np.arange(wide, dtype=np.uint8) <= more[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers of pack(): lengths by table look-up, bytes by one mask."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    wide = 4 if length.max(initial=1) > 2 else 2
    out = np.zeros((n, wide), np.uint8)
    out[np.arange(wide, dtype=np.uint8) < length[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view(f"<u{wide}").astype(np.uint32)


def _width(most: int) -> int:
    """Bytes to hold integers of up to most in: 2 or 4."""
    return 2 if most <= 0xFFFF else 4


def to_bytes(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One file of the ids of documents, sizes[i] of them for the i-th."""
    most = int(ids.max(initial=0))
    if most < TABLE_IDS:
        every = np.bincount(ids, minlength=1)
        distinct = np.flatnonzero(every)
        count, place = every[distinct], None
    else:
        distinct, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    if place is None:
        table = np.zeros(most + 1, np.uint32)
        table[distinct] = rank
        ranks = table[ids]
    else:
        ranks = rank[place]
    control, data = pack(ranks) if len(ids) else (b"", b"")
    head = np.array([len(sizes), len(ids), len(distinct), len(data), 0], "<i8")
    return b"".join([MAGIC, head.tobytes(), distinct[order].astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), control, data])


def from_bytes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of a file."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, distinct, size, _ = np.frombuffer(blob, "<i8", 5, 8).tolist()
    at = 48
    by_rank = np.frombuffer(blob, "<u4", distinct, at)
    sizes = np.frombuffer(blob, "<u4", docs, at := at + 4 * distinct)
    at += 4 * docs
    control = blob[at : at + -(-n // 4)]
    data = blob[at + len(control) : at + len(control) + size]
    ids = by_rank[unpack(control, data, n)] if n else np.zeros(0, np.uint32)
    return ids, sizes.astype(np.int64)


#: Marks that may follow a word; fixed values.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than the space and the line feed; fixed values.
_ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ODD_OTHER = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Texts whose ids tell how a tokenizer treats spaces, letters and marks.
PROBES = [
    "the end of the line, and a new one. Then \"more\" (of it)!", "a b c d e f g", "It's they've I'm we'll o'clock 'tis rock'n'roll", "in 2024 there were 10,000 and 3.14 of 1st 2nd x2 b2b",
    "straße élan über naïve, Ænima; coöperate: señor? façade", "слово за словом, и ещё одно.", "中文 字符 和 标点。 还有 更多", "ทดสอบ ภาษา नमस्ते दुनिया مرحبا بالعالم", "A.B.C. U.S.A. e.g. i.e. etc... end -- dash - x_y __init__ a/b c\\d #tag @name $5 50%",
    "Lines end.\nNew ones, (begin)\n'tis so\n- item\n\n2nd part\nГлава о\n中文 \u0120a \u2581b \u010ac", "HELLO World CamelCase mixedUP iPhone", "\U0001f600 smile \U0001f468\u200d\U0001f469 family e\u0301 combining", "aaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbbbbb zzzzzz",
]


class Encoder:
    """The tokenizers library with a bounded cache of words.

    A byte-level pattern never joins a space to what stands before it, nor a
    single line feed to what stands beside it, so a text whose words are parted
    by these is encoded word by word: its words are found and counted by Arrow,
    and each new one goes to the library once, many as one text. Other texts,
    and those with special tokens in them, go to the library whole, as do all
    texts of a tokenizer that PROBES show to be of another kind.

    A word has a number, under which start, size and pool hold its ids. Words
    after a space are named without it, those after a line feed with it; a text
    begins as if a line feed stood before it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.number: dict[str, int] = {}
        #: Numbers of marks without anything before them.
        self.marks: dict[str, int] = {}
        self.used, self.filled = 0, 0
        self.start, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        line = self._whole(["\n"])[0]
        vocabulary = self.tokenizer.get_vocab()
        spaced, lined = (np.zeros(max(vocabulary.values(), default=0) + 1, bool) for _ in range(2))
        spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level tokens show a space
        lined[line] = True
        #: Whether an id begins a word after a space, or after a line feed.
        self.begins = {" ": spaced, "\n": lined}
        self.line = line
        self.by_word = len(line) == 1 and not any(c.isspace() for s in self.special for c in s) and all(self._fits(text) for text in PROBES)

    def _fits(self, text: str) -> bool:
        """Whether a text's ids are those of its words, and of its words' letters and marks, one after the other."""
        parts = []
        for word in self._named(text).split(" "):
            core = self._core(word)
            own = [core, word[len(core) :]] if core else [word]
            parts += [own[0] if own[0].startswith("\n") else " " + own[0], *own[1:]]
        return np.concatenate([self.line, *self._whole([text])]).tolist() == np.concatenate(self._whole(parts)).tolist()

    @staticmethod
    def _named(text: str) -> str:
        """A text whose words, parted by spaces, are named as in the cache. Several line feeds that may be one token stay in a word."""
        return "\n" + (text if "\n\n\n" in text else text.replace("\n", " \n"))

    @staticmethod
    def _core(word: str) -> str:
        """The letters of a word that marks follow, as these never join and are encoded apart; else nothing."""
        core = word.rstrip(_MARKS)
        return core if len(core) < len(word) and (core[1:] if core.startswith("\n") else core).isalpha() else ""

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has: encoded as one text, cut at the ids that begin with what stands before each."""
        own = [w if w.startswith("\n") else before + w for w in words]
        ids = self._whole(["".join(own)])[0]
        begins = np.flatnonzero(self.begins[before][ids])
        if len(begins) == len(words) and begins[0] == 0:
            return ids, np.diff(begins, append=len(ids))
        return _in_one(self._whole(own))

    def _plain(self, text: str) -> bool:
        if not self.by_word or not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text:
            return False
        odd = _ODD_ASCII if text.isascii() else _ODD_ASCII + _ODD_OTHER
        return not any(c in text for c in odd) and not any(s in text for s in self.special)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Hold the ids of words, sizes[i] of them for the i-th; the words' numbers."""
        first, filled = self.used, self.filled
        self.used, self.filled = first + len(sizes), filled + len(ids)
        if self.used > len(self.start):
            self.start, self.size = (np.concatenate([x[:first], np.zeros(self.used + first // 2 - first, np.int64)]) for x in (self.start, self.size))
        if self.filled > len(self.pool):
            self.pool = np.concatenate([self.pool[:filled], np.zeros(self.filled + filled // 2 - filled, np.uint32)])
        self.pool[filled : self.filled] = ids
        self.size[first : self.used] = sizes
        self.start[first : self.used] = filled + np.cumsum(sizes) - sizes
        return range(first, self.used)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their numbers, one after the other, and how many each has."""
        sizes = self.size[numbers]
        stops = np.cumsum(sizes)
        at = np.repeat(self.start[numbers] - stops + sizes, sizes)
        at += np.arange(len(at))
        return self.pool[at], sizes

    def _numbers(self, words: list[str], wholes: dict[str, str]) -> tuple[np.ndarray, tuple[int, int]]:
        """Numbers of words, and how much of start and pool is to stay in use. wholes: the texts that some words stand for."""
        known = self.number
        out = list(map(known.get, words))
        new: dict[str, dict[str, int]] = {" ": {}, "\n": {}}
        new_marks: dict[str, int] = {}
        plain, marked, apart = [], [], []
        for k in [k for k, number in enumerate(out) if number is None]:
            word = words[k]
            if len(word) > LONG_WORD or word in wholes:
                apart.append(k)
                continue
            core = self._core(word)
            if core:
                marks = word[len(core) :]
                marked.append((k, core, marks))
                if marks not in self.marks:
                    new_marks[marks] = 0
                if core in known:
                    continue
            else:
                plain.append(k)
                core = word
            new["\n" if core.startswith("\n") else " "][core] = 0
        held = self.used, self.filled
        new_marks = dict(zip(new_marks, self._add(*_in_one(self._whole(list(new_marks)))), strict=True))
        fresh: dict[str, int] = {}
        for before, some in new.items():
            every = list(some)
            for k in range(0, len(every), JOINED_WORDS):
                piece = every[k : k + JOINED_WORDS]
                fresh.update(zip(piece, self._add(*self._joined(piece, before)), strict=True))
        for k in plain:
            out[k] = fresh[words[k]]
        with_words = self.used, self.filled
        # marks after letters: ids of both, without the library
        pairs = [n for _, core, marks in marked for n in (known[core] if core in known else fresh[core], self.marks[marks] if marks in self.marks else new_marks[marks])]
        ids, sizes = self._gather(np.array(pairs, np.int64))
        for (k, _, _), number in zip(marked, self._add(ids, sizes[::2] + sizes[1::2]), strict=True):
            out[k] = number
        with_marked = self.used, self.filled
        own = self._whole([wholes[w] if w in wholes else w if w.startswith("\n") else " " + w for w in map(words.__getitem__, apart)])
        own = [np.concatenate([np.zeros(1, np.uint32), ids]) if words[k] in wholes else ids for k, ids in zip(apart, own, strict=True)]
        for k, number in zip(apart, self._add(*_in_one(own)), strict=True):
            out[k] = number
        if len(known) < CACHE_WORDS and held[1] < CACHE_IDS:
            held = with_words
            known.update(fresh)
            self.marks.update(new_marks)
            if len(known) < CACHE_WORDS // 2:  # these are soon put together again
                held = with_marked
                known.update((words[k], out[k]) for k, _, _ in marked)
        return np.array(out, np.int64), held

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one more id before those of each, and how many each has with that."""
        named, wholes = [], {}
        for k, text in enumerate(texts):
            if self._plain(text):
                named.append(self._named(text))
            else:
                named.append(name := f"\r{k}")  # no plain text has a carriage return
                wholes[name] = text
        words = pc.split_pattern(pa.array(named, pa.large_string()), " ")
        found = words.values.dictionary_encode()
        numbers, held = self._numbers(found.dictionary.to_numpy(zero_copy_only=False).tolist(), wholes)
        ids, sizes = self._gather(numbers[found.indices.to_numpy()])
        self.used, self.filled = held
        stops = np.concatenate([[0], np.cumsum(sizes)])[words.offsets.to_numpy()]
        return ids, np.diff(stops)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, sizes = self.stream(texts)
        stops = np.cumsum(sizes).tolist()
        return [ids[a + 1 : b].astype("<u4").tobytes() for a, b in zip([0, *stops], stops, strict=False)]


def _in_one(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after the other, and how many each has."""
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, doc_ids array<long>"


def _write(tokenizer: str, folder: str, end_id: int, file_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def close():
            nonlocal seq, held
            sizes, ids = np.concatenate(counts), pa.concat_arrays(names)
            file = write_file(folder, f"tokens-{part:06d}-{seq:04d}", ".tok", to_bytes(np.concatenate(parts), sizes))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([file]), pa.array([len(sizes)], pa.int64()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                ["part", "seq", "file", "n_docs", "n_ids", "doc_ids"],
            )
            seq, held = seq + 1, 0
            for kept in (parts, counts, names):
                kept.clear()
            return row

        for batch in batches:
            for some in slices(batch, SLICE_ROWS, SLICE_BYTES):
                ids, sizes = enc.stream([t or "" for t in some.column("text").to_pylist()])
                stops = np.cumsum(sizes)
                ids[stops - sizes] = end_id  # each text's end id takes the place before the next text
                ids = np.roll(ids, -1)
                k = at = 0
                while k < len(sizes):
                    n = min(int(np.searchsorted(stops, at + file_ids - held)) + 1, len(sizes))
                    stop = int(stops[n - 1])
                    parts.append(ids[at:stop])
                    counts.append(sizes[k:n])
                    names.append(some.column("doc_id").slice(k, n - k))
                    held += stop - at
                    k, at = n, stop
                    if held >= file_ids:
                        yield close()
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append end_id, write token files in ascending order of id_col; the manifest.

    The manifest has a row a file: part and seq (files in this order hold the
    documents in order), file, n_docs, n_ids, doc_ids. A null text is empty and
    has the end id alone; null ids come first; rows that repeat an id are
    neighbours in any order. No rows make no files. A text of any length is one
    document, if need be in a file of its own. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return staged(rows.mapInArrow(_write(tokenizer, folder, end_id, file_ids), _MANIFEST), "manifest")


def _read(folder: str, with_ids: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = from_bytes(read_file(folder, row["file"]))
                stops = np.cumsum(sizes)
                raw = ids.astype("<u4")
                pieces = [raw[a:b] for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["at"] + stops - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([p.tobytes() for p in pieces], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids, read from the files.

    Offsets of files come from sums by partition of the writing job, a row
    each, and a running sum within a partition.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("inner", inner).join(parts.select("part", "before"), "part").withColumn("at", F.col("before") + F.col("inner"))
    files = int(manifest.count())
    placed = placed.select("file", "doc_ids", "at").repartition(max(1, min(files, 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    return placed.mapInArrow(_read(folder, with_ids), schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Token files of docs in the shared folder, and what is read back from them."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id), folder)
