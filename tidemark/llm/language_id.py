"""Language identification of spans.

Each word gets a score for every learned language from the character pairs and
triples in it. Languages that do not use the word's script are out of question
for it. Viterbi over a text's words, with a penalty for changing the language
between neighbours, labels spans; the language with most letters is the text's.
The tables are counts over a bounded sample of labelled texts, made in tasks.
They stand in blocks of a bounded number of languages: one is broadcast, of
several each is a file that a worker reads in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh_path, slices, small, staged, unlike
from tidemark.llm.files import read_file, write_file

#: Texts of a language that are learned from, about: those with the least hash of their id.
MAX_TRAIN_DOCS = 3000
#: Languages in a block of tables, which take half a megabyte for each.
BLOCK_LANGS = 64
#: Scores of words that a task holds at once, but for those of one text.
HELD_SCORES = 8 << 20
#: Letters that are looked up at once.
LETTERS = 1 << 16
#: Log probability that a change of language between two words costs.
SWITCH = 12.0
#: A language uses a script if so large a share of its letters is in it.
SCRIPT_SHARE = 0.005
#: Hash buckets of character pairs and triples.
BUCKETS = 1 << 16
#: Number of the first script's letters among a language's counts; pairs' features come after those of triples.
_SCRIPT = 2 * BUCKETS
#: Added to each bucket's count.
ADDED = 0.5
UNKNOWN = "und"

#: First code points of ranges of one script; fixed values. What lies before a range's start belongs to the one before.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x40000, "Other"),
]
_NAMES = sorted({name for _, name in SCRIPTS})
_CODE: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """By code point: whether it is a letter, its lower case, its script."""
    if not _CODE:
        points = range(0x110000)
        surrogate = lambda c: 0xD800 <= c < 0xE000
        _CODE["letter"] = np.array([not surrogate(c) and chr(c).isalpha() for c in points], bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(_CODE["letter"]).tolist():
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        _CODE["lower"] = lower
        starts = np.array([s for s, _ in SCRIPTS])
        index = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int8)
        _CODE["script"] = index[np.searchsorted(starts, np.arange(0x110000), "right") - 1]
    return _CODE


class Words:
    """The words (runs of letters) of some texts: features by letter, and where words and texts begin."""

    def __init__(self, texts: list[str | None]):
        t = _tables()
        points = [np.frombuffer((x or "").encode("utf-32-le"), "<u4") for x in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        every = np.concatenate(points) if points else np.zeros(0, np.uint32)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        letter = t["letter"][every]
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        inner = edges[(edges > 0) & (edges < len(every))]
        begins[inner] = letter[inner]
        places = np.flatnonzero(letter)
        first = begins[places]
        #: Per word: its first letter among the letters, its place among the code points; per text: its first word.
        self.starts = np.flatnonzero(first)
        self.places = places[self.starts]
        self.lengths = np.diff(np.append(self.starts, len(places)))
        self.texts = np.searchsorted(self.places, edges)
        self.offsets = self.places - np.repeat(edges[:-1], np.diff(self.texts)) if len(texts) else self.places
        c0 = t["lower"][every[places]].astype(np.uint64)
        self.script = t["script"][every[places[self.starts]]] if len(self.starts) else np.zeros(0, np.int8)
        one, two = np.zeros_like(c0), np.zeros_like(c0)
        one[1:] = c0[:-1]
        one[first] = 0
        two[2:] = c0[:-2]
        two[first] = 0
        two[1:][first[:-1]] = 0
        last = np.ones(len(c0), bool)
        last[:-1] = first[1:]
        mix = lambda a, b, c: ((a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F) ^ c * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)
        with np.errstate(over="ignore"):
            self.triple, self.pair = mix(two + np.uint64(1), one, c0), mix(np.uint64(0) * c0, one, c0)
            end = mix(one + np.uint64(3), c0, np.uint64(0) * c0)
        #: The end of a word counts in the feature of its last letter's pair.
        self.pair[last] = end[last]

    def __len__(self) -> int:
        return len(self.starts)


class Tables:
    """Logarithms by feature and language of a block of languages, and where their scripts bar them."""

    def __init__(self, counts: np.ndarray, scripts: np.ndarray):
        shares = (counts + ADDED) / (counts.sum(axis=1, keepdims=True) + ADDED * counts.shape[1])
        self.logs = np.ascontiguousarray(np.log(shares).T.astype(np.float32))
        #: By language and script: whether the language uses it.
        self.used = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE

    def word_scores(self, w: Words, known: np.ndarray) -> np.ndarray:
        """Scores by word and language; known: by script, whether any language of the model uses it."""
        out = np.zeros((len(w), self.logs.shape[1]), np.float32)
        ends = w.starts + w.lengths
        bars = np.where(self.used.T | ~known[:, None], 0.0, -1e4).astype(np.float32)
        low = 0
        while low < len(w):  # a bounded number of letters at a time
            high = max(low + 1, int(np.searchsorted(ends, w.starts[low] + LETTERS, "right")))
            a, b = int(w.starts[low]), int(ends[high - 1])
            letters = self.logs[w.triple[a:b]] + self.logs[w.pair[a:b] + BUCKETS]
            out[low:high] = np.add.reduceat(letters, w.starts[low:high] - a, axis=0) + bars[w.script[low:high]]
            low = high
        return out

    def to_bytes(self) -> bytes:
        return np.array(self.logs.shape, "<i8").tobytes() + self.logs.astype("<f4").tobytes() + np.packbits(self.used, axis=None).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Tables:
        rows, n = np.frombuffer(blob, "<i8", 2).tolist()
        out = cls.__new__(cls)
        out.logs = np.frombuffer(blob, "<f4", rows * n, 16).reshape(rows, n)
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=16 + 4 * rows * n))
        out.used = bits[: n * len(_NAMES)].reshape(n, len(_NAMES)).astype(bool)
        return out


class LanguageModel:
    """The languages in order of their names, and their tables in blocks: one block here, several in files under folder."""

    def __init__(self, langs: list[str], tables: Tables | None, known: np.ndarray, folder: str = "", files: list[str] | None = None):
        self.langs, self.tables, self.known, self.folder, self.files = langs, tables, known, folder, files or []

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w) or not self.langs:
            return np.zeros((len(w), max(1, len(self.langs))), np.float32)
        if self.tables is not None:
            return self.tables.word_scores(w, self.known)
        out, at = np.empty((len(w), len(self.langs)), np.float32), 0
        for file in self.files:
            block = Tables.from_bytes(read_file(self.folder, file))
            out[:, at : at + block.logs.shape[1]] = block.word_scores(w, self.known)
            at += block.logs.shape[1]
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; first has where each text's words begin. All texts move on together."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    out = np.zeros(len(scores), np.int64)
    if not len(order):
        return out
    n, starts = sizes[order], first[:-1][order]
    alive = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts with more than t words
    value = scores[starts].astype(np.float64)
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32)
    lang = np.arange(scores.shape[1])
    for t in range(1, int(n[0])):
        k = int(alive[t])
        v = value[:k]
        best = v.argmax(axis=1)
        top = v[np.arange(k), best][:, None] - switch
        stay = v >= top
        value[:k] = np.where(stay, v, top) + scores[starts[:k] + t]
        came[starts[:k] + t] = np.where(stay, lang, best[:, None])
    state = value.argmax(axis=1)
    for t in range(int(n[0]) - 1, -1, -1):
        k = int(alive[t])
        at = starts[:k] + t
        out[at] = state[:k]
        state[:k] = came[at, state[:k]] if t else state[:k]
    return out


def _count(batches):
    """(lang, feature, n) of texts: how often a language has a feature; a few hundred thousand counts at most stand in a batch."""
    for batch in (part for whole in batches for part in slices(whole, 256, 1 << 20)):
        langs, own = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        w = Words(batch.column("text").to_pylist())
        of_word = np.repeat(own, np.diff(w.texts))
        of_letter = np.repeat(of_word, w.lengths)
        width = _SCRIPT + len(_NAMES)
        keys = np.concatenate([of_letter * width + w.triple, of_letter * width + BUCKETS + w.pair, np.repeat(of_word * width + _SCRIPT + w.script, w.lengths)])
        keys, n = np.unique(np.concatenate([keys, np.arange(len(langs)) * width + _SCRIPT]), return_counts=True)
        n[np.searchsorted(keys, np.arange(len(langs)) * width + _SCRIPT)] -= 1  # so that a language without letters is learned too
        yield pa.RecordBatch.from_arrays([pa.array(langs[keys // width], pa.string()), pa.array(keys % width, pa.int32()), pa.array(n, pa.int64())], ["lang", "feature", "n"])


def _dense(rows) -> tuple[np.ndarray, np.ndarray]:
    """Counts by language and feature, and by language and script, of (features, counts) in binary."""
    every = np.zeros((len(rows), _SCRIPT + len(_NAMES)), np.int64)
    for k, (features, counts) in enumerate(rows):
        every[k, np.frombuffer(features, "<i4")] = np.frombuffer(counts, "<i8")
    return every[:, :_SCRIPT], every[:, _SCRIPT:]


def _pack(table: pa.Table) -> pa.Table:
    """One language's counts in one row, and its scripts."""
    features, counts = table.column("feature").to_numpy().astype("<i4"), table.column("n").to_numpy().astype("<i8")
    scripts = Tables(*_dense([(features.tobytes(), counts.tobytes())])).used[0]
    return pa.table({"lang": [table.column("lang")[0].as_py()], "features": pa.array([features.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "scripts": pa.array([np.flatnonzero(scripts).tolist()], pa.list_(pa.int32()))})


def _write_block(folder: str):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("lang").to_pylist(), table.column("features").to_pylist(), table.column("counts").to_pylist(), strict=True))
        name = write_file(folder, "languages", ".bin", Tables(*_dense([r[1:] for r in rows])).to_bytes())
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "file": [name]})

    return run


def fit(docs: DataFrame, train=None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, block_langs: int = BLOCK_LANGS) -> LanguageModel:
    """A model from about max_docs texts of each language among the rows that ``train`` (a condition) lets in.

    Null texts and languages are left out; a row without id is drawn by its
    text. Counts are added up by language and feature. Any number of languages
    is learned; the driver holds their names and one block of tables.
    """
    rows = docs if train is None else docs.filter(F.coalesce(train, F.lit(True)))
    drawn = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), drawn.alias("drawn")).filter("lang is not null and text is not null")
    grid = 1 << 20
    shares = rows.groupBy("lang").count().select("lang", F.least(F.lit(grid), F.ceil(F.lit(float(max_docs) * grid) / F.col("count"))).alias("share"))
    some = rows.join(small(staged(shares, "shares")), "lang").filter(F.pmod("drawn", F.lit(grid)) < F.col("share"))
    summed = some.select("lang", "text").mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = staged(summed.groupBy("lang").applyInArrow(_pack, "lang string, features binary, counts binary, scripts array<int>"), "languages")
    langs = sorted(r["lang"] for r in table.select("lang").collect())
    known = np.zeros(len(_NAMES), bool)
    known[[r[0] for r in table.select(F.explode("scripts")).distinct().collect()]] = True
    if len(langs) <= block_langs:
        found = sorted(table.select("lang", "features", "counts").toLocalIterator(), key=lambda r: r["lang"])
        return LanguageModel(langs, Tables(*_dense([r[1:] for r in found])) if found else None, known)
    folder = fresh_path(docs.sparkSession, "languages")
    numbered = docs.sparkSession.createDataFrame([(lang, k // block_langs) for k, lang in enumerate(langs)], "lang string, block int")
    made = staged(table.join(numbered, "lang").select("block", "lang", "features", "counts").groupBy("block").applyInArrow(_write_block(folder), "block int, file string"), "blocks")
    return LanguageModel(langs, None, known, folder, [r["file"] for r in made.orderBy("block").collect()])


_SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _predict(sent, keep: list[str], text_col: str, spans: bool, switch: float):
    def run(batches):
        m = sent.value
        n = max(1, len(m.langs))
        for batch in (part for whole in batches for part in slices(whole, 4096, max(1 << 16, min(1 << 20, 4 * HELD_SCORES // n)))):
            texts = batch.column(text_col).to_pylist()
            w = Words(texts)
            first = w.texts
            lang = viterbi(m.word_scores(w), first, switch)
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            seen, at = np.unique(text * n + lang, return_inverse=True)
            letters = np.bincount(at, weights=w.lengths, minlength=len(seen)).astype(np.int64)
            of = seen // n
            total = np.bincount(of, weights=letters, minlength=len(texts)).astype(np.int64)
            order = np.lexsort((seen % n, -letters, of))  # by text, the language with most letters first, of equal ones the first by name
            top = order[np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0]))] if len(seen) else order
            best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            best[of[top]] = seen[top] % n
            share[of[top]] = letters[top] / np.maximum(1, total[of[top]])
            learned = bool(m.langs)
            names = [m.langs[b] if t and learned else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)]
            columns = [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(share if learned else np.zeros(len(texts)))]
            out = [*keep, "lang_pred", "score"]
            if spans:
                columns.append(pa.array(_spans(m.langs or [UNKNOWN], lang, first, w.offsets, w.lengths), pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                out.append("spans")
            yield pa.RecordBatch.from_arrays(columns, out)

    return run


def _spans(langs: list[str], lang: np.ndarray, first: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> list[list[dict]]:
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own: list[dict] = []
        for k in range(a, b):
            name, end = langs[lang[k]], int(offsets[k] + lengths[k])
            if own and own[-1]["lang"] == name:
                own[-1]["end"] = end
            else:
                own.append({"lang": name, "start": int(offsets[k]), "end": end})
        out.append(own)
    return out


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text_col: str = "text", spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """The columns ``keep`` of docs (all unless given), lang_pred, score and, if asked for, spans (lang, start, end in characters).

    score is the share of the text's letters in spans of lang_pred. A null text,
    or one without letters, is UNKNOWN with score 0 and no spans, as is every
    text if nothing was learned. Ties go to the first language by name. Rows
    that repeat a text have equal results, an empty table gives an empty one, a
    text of any length is read whole. A kept column with the name of a result
    gives way to it.
    """
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + ([T.StructField("spans", T.ArrayType(_SPAN))] if spans else [])
    keep = unlike(docs.columns if keep is None else keep, [f.name for f in results])
    fields = {f.name: f for f in docs.schema.fields}
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    return rows.mapInArrow(_predict(sent, keep, text_col, spans, switch), T.StructType([fields[c] for c in keep] + results))
