"""SentencePiece encoding and decoding, with a parallel scan for giant documents.

A sequence of pieces is the encoding of a text under ranked merges exactly if
each two neighbouring pieces, put together, encode to themselves. So encoding
is the best path through the lattice of pieces where a step between pieces
that may stand together weighs 0 and any other minus infinity. A giant text is
cut into chunks; the state at a cut is the piece that covers the character
there. Each chunk yields its max-plus transfer matrix between the states of
its two cuts; products of matrices, which are associative, give the state at
every cut, and each chunk is then traced back on its own.

No piece reaches over the place where a space follows another character, if the
model's pieces say so. There the lattice has one state, and what lies between
two such places, a word, has a matrix of one row and one column whose path
depends on the word alone: a worker walks each distinct word once and remembers
its ids. Other texts are so many words, encoded where they lie. The library
reads the model's file, normalises texts and decodes; every id that encode()
gives comes from the lattice.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, slices, staged, unlike

#: Texts of more characters are giant and go through the scan, in chunks of CHUNK characters.
GIANT, CHUNK = 65_536, 16_384
#: Chunks whose matrices one task multiplies.
BLOCK = 64
CACHE_WORDS, CACHE_STEPS = 180_000, 600_000
#: Words of more characters are walked each time.
CACHE_CHARS = 64
#: Bytes of texts or ids that are held as Python objects at a time.
GROUP_BYTES = 1 << 20
SPACE = "▁"
_BREAK = re.compile(f"[^{SPACE}](?={SPACE})")
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

State = tuple[int, int]
#: Rows and finite entries of a max-plus matrix.
Matrix = dict[State, dict[State, float]]
START: State = (0, 0)


class Codec:
    """A model, its lattice and a cache of words; one in each worker."""

    def __init__(self, model: str):
        import sentencepiece  # reads the model, normalises and decodes; encodes nothing

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(self.sp.get_piece_size())
        plain = [i for i in ids if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        self.rank = {piece: -self.sp.get_score(i) for piece, i in self.ids.items()}
        self.byte = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: Whether words can be told by spaces: no piece has one after another character.
        self.by_word = all(SPACE not in piece.lstrip(SPACE) for piece in self.ids)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Pieces by number, characters outside the vocabulary among them as they come; 0 is the beginning of a text.
        self.pieces: list[str] = [""]
        self.coded: list[bytes] = [b""]
        self.number: dict[str, int] = {"": 0}
        #: A node has nodes by character, and at "" the number of the piece that ends there.
        self.tree: dict = {}
        for piece in self.ids:
            self.add(piece)
        #: Which piece may follow which, by both numbers.
        self.steps: dict[int, bool] = {}

    def add(self, piece: str) -> int:
        """The number of a piece, or of a character that stands for its bytes."""
        n = self.number.get(piece)
        if n is None:
            n = self.number[piece] = len(self.pieces)
            self.pieces.append(piece)
            self.coded.append(np.array([self.ids[piece]] if piece in self.ids else [self.byte[b] for b in piece.encode()], "<u4").tobytes())
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = n
        return n

    def word(self, word: str) -> bytes:
        """Ids of a normalised word or text; a distinct word is walked once and remembered."""
        known = self.cache.get(word)
        if known is None:
            known = self.older.get(word) or self.path(word)
            if len(word) <= CACHE_CHARS:
                if len(self.cache) > CACHE_WORDS:  # words not met again since go
                    self.cache, self.older = {}, self.cache
                self.cache[word] = known
        return known

    def path(self, text: str) -> bytes:
        """Ids of the best path through the whole lattice of a text.

        The pieces on the way to a place are the encoding of what is before
        it, so of all pieces that end there one alone can be reached.
        """
        end, tree, steps = len(text), self.tree, self.steps
        last, came = [-1] * (end + 1), [0] * (end + 1)
        last[0] = 0
        for at in range(end):
            before = last[at]
            key = before << 32
            node = tree.get(text[at])
            if node is None or "" not in node:
                self.add(text[at])
                node = tree[text[at]]
            j = at + 1
            while node is not None:
                n = node.get("")
                if n is not None and last[j] < 0:
                    fits = steps.get(key | n)
                    if fits or fits is None and self.follows(before, n):
                        last[j], came[j] = n, at
                node = node.get(text[j]) if j < end else None
                j += 1
        out, at = [], end
        while at:
            out.append(self.coded[last[at]])
            at = came[at]
        return b"".join(reversed(out))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return [b"".join(map(self.word, self.split(self.sp.normalize(t)))) if t else b"" for t in texts]

    def split(self, text: str) -> list[str]:
        """A normalised text cut wherever a space follows another character."""
        if not text or not self.by_word:
            return [text] if text else []
        if SPACE + SPACE not in text and text[0] == SPACE != text[-1]:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return _WORD.findall(text)

    def decode(self, blobs: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(b, "<u4").tolist() for b in blobs], num_threads=1)

    # --- the lattice

    def merge(self, text: str) -> list[str]:
        """Ranked merges over a short text: the best-ranked pair, and of these the leftmost, first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece number b may stand after piece number a; at the beginning (0) whether it is its own encoding."""
        key = a << 32 | b
        known = self.steps.get(key)
        if known is None:
            if len(self.steps) > CACHE_STEPS:
                self.steps.clear()
            first, then = self.pieces[a], self.pieces[b]
            known = self.steps[key] = self.merge(first + then) == ([first, then] if a else [then])
        return known

    def states(self, text: str, cut: int) -> list[State]:
        """Pieces (from, to) that cover the character at cut."""
        out = []
        for i in range(max(0, cut - self.longest + 1), cut + 1):
            for j in range(cut + 1, min(len(text), i + self.longest) + 1):
                if (j == i + 1 or text[i:j] in self.rank) and self.follows(0, self.add(text[i:j])):
                    out.append((i, j))
        return out

    def walk(self, text: str, entries: list[State], cut: int | None, trace: dict | None = None) -> dict[State, int]:
        """States at cut (or at the end of text, where cut is None) and, as bits, the entries that reach them.

        All finite weights are 0, so which entries reach a piece is kept as bits.
        """
        end = len(text)
        alive: dict[int, list[tuple[State, int]]] = {}
        out: dict[State, int] = {}

        def put(piece: State, bits: int) -> None:
            if cut is not None and piece[0] <= cut < piece[1] or cut is None and piece[1] == end:
                out[piece] = out.get(piece, 0) | bits
            elif piece[1] <= (end if cut is None else cut):
                alive.setdefault(piece[1], []).append((piece, bits))

        for k, piece in enumerate(entries):
            put(piece, 1 << k)
        at = min((p for _, p in entries), default=end)
        stop = end - 1 if cut is None else cut
        follows, tree = self.follows, self.tree
        while at <= stop:
            here = alive.pop(at, None)
            if here:
                named = [(self.add(text[p[0] : p[1]]), p, bits) for p, bits in here]
                node, j = tree, at
                self.add(text[at])
                while j < end and (node := node.get(text[j])) is not None:
                    j += 1
                    n = node.get("")
                    if n is None:
                        continue
                    bits = 0
                    for before, p, b in named:
                        if follows(before, n):
                            bits |= b
                            if trace is not None:
                                trace[at, j] = p
                    if bits:
                        put((at, j), bits)
            at += 1
        return out


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two sparse matrices."""
    out: Matrix = {}
    for row, middle in a.items():
        best: dict[State, float] = {}
        for m, w in middle.items():
            for column, v in b.get(m, {}).items():
                best[column] = max(best.get(column, -np.inf), w + v)
        if best:
            out[row] = best
    return out


def _packed(m: Matrix) -> bytes:
    return np.array([(*r, *c, w) for r, row in m.items() for c, w in row.items()], "<f8").tobytes()


def _unpacked(blob: bytes) -> Matrix:
    out: Matrix = {}
    for a, b, c, d, w in np.frombuffer(blob, "<f8").reshape(-1, 5).tolist():
        out.setdefault((int(a), int(b)), {})[int(c), int(d)] = w
    return out


def _chunks(model: str, chunk: int):
    """(key, k, last, left, body) of giant texts: body with what lies around it, left the characters before the cut."""

    def run(batches):
        c = codec(model)
        schema = pa.schema([("key", pa.string()), ("k", pa.int32()), ("last", pa.bool_()), ("left", pa.int32()), ("cut", pa.int32()), ("body", pa.string())])
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = c.sp.normalize(text)
                cuts = list(range(0, len(text), chunk))
                for k, cut in enumerate(cuts):
                    lo, hi = max(0, cut - c.longest), min(len(text), cut + chunk + c.longest)
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "last": k == len(cuts) - 1, "left": cut - lo, "cut": cut + chunk - lo, "body": text[lo:hi]}], schema)

    return run


_CHUNKS = "key string, k int, last boolean, left int, cut int, body string"


def _moved(states, by: int):
    """States relative to their cut."""
    return [(i - by, j - by) for i, j in states]


def _places(c: Codec, body: str, low: int, high: int) -> list[int]:
    """The places in [low, high] where a space follows another character: there the lattice has one state."""
    return [m.start() + 1 for m in _BREAK.finditer(body, max(low - 1, 0), min(high + 1, len(body)))] if c.by_word else []


def transfer(c: Codec, body: str, left: int, cut: int, first: bool, last: bool) -> Matrix:
    """The matrix of one chunk, its states relative to the cuts; first and last have one row or column, START."""
    entries = [(0, 0)] if first else c.states(body, left)
    goal = None if last else cut
    places = _places(c, body, max(j for _, j in entries), len(body) - 1 if last else cut)
    if places:
        head = 0
        for bits in c.walk(body[: places[0]], entries, None).values():
            head |= bits
        for a, b in zip(places, places[1:], strict=False):  # matrices of one row and one column
            head = head if c.word(body[a:b]) else 0
        tail = c.walk(body[places[-1] :], [START], None if last else cut - places[-1])
        reached = {(i + places[-1], j + places[-1]): head for i, j in tail}
    else:
        reached = c.walk(body, entries, goal)
    names = [START] if first else _moved(entries, left)
    out: Matrix = {}
    for (i, j), bits in reached.items():
        to = START if last else (i - cut, j - cut)
        for k, name in enumerate(names):
            if bits >> k & 1:
                out.setdefault(name, {})[to] = 0.0
    return out


def _path(c: Codec, body: str, start: State, cut: int | None, leave: State | None) -> bytes:
    before: dict[State, State] = {}
    reached = c.walk(body, [start], cut, before)
    at = next(iter(reached)) if leave is None else leave
    pieces = []
    while at != start:
        pieces.append(body[at[0] : at[1]])
        at = before[at]
    return b"".join([c.coded[c.add(piece)] for piece in reversed(pieces)])


def trace_back(c: Codec, body: str, left: int, cut: int, entry: State | None, leave: State | None) -> bytes:
    """Ids of the pieces after the entry piece up to and with the leaving piece (or the text's end)."""
    start = (0, 0) if entry is None else (entry[0] + left, entry[1] + left)
    at = None if leave is None else (leave[0] + cut, leave[1] + cut)
    places = _places(c, body, max(start[1], 1), len(body) - 1 if leave is None else cut)
    while places and at is not None and at[0] < places[-1]:
        places.pop()
    if not places:
        return _path(c, body, start, None if leave is None else cut, at)
    end = None if at is None else (at[0] - places[-1], at[1] - places[-1])
    head = _path(c, body[: places[0]], start, None, None)
    tail = _path(c, body[places[-1] :], START, None if leave is None else cut - places[-1], end)
    middle = [c.word(body[a:b]) for a, b in zip(places, places[1:], strict=False)]
    return b"".join([head, *middle, tail])


def _matrices(model: str):
    def run(batches):
        c = codec(model)
        for batch in batches:
            rows = batch.to_pylist()
            m = [_packed(transfer(c, r["body"], r["left"], r["cut"], r["k"] == 0, r["last"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array([r["k"] // BLOCK for r in rows], pa.int32()), pa.array(m, pa.binary())], ["key", "k", "block", "matrix"])

    return run


def _block_product(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    whole = _unpacked(rows[0]["matrix"])
    for r in rows[1:]:
        whole = product(whole, _unpacked(r["matrix"]))
    return pa.table({"key": [rows[0]["key"]], "block": pa.array([rows[0]["block"]], pa.int32()), "matrix": pa.array([_packed(whole)], pa.binary())})


def best_states(matrices: list[Matrix], first: State, last: State) -> list[State]:
    """States before, between and after the matrices on the best way from first to last."""
    reached: dict[State, float] = {first: 0.0}
    came: list[dict[State, State]] = []
    for m in matrices:
        best: dict[State, float] = {}
        before: dict[State, State] = {}
        for state, w in reached.items():
            for to, v in m.get(state, {}).items():
                if w + v > best.get(to, -np.inf):
                    best[to], before[to] = w + v, state
        reached = best
        came.append(before)
    out = [last]
    for before in reversed(came):
        out.append(before[out[-1]])
    return out[::-1]


def _scan(name: str):
    """States on entering and leaving each row, in order of the column name."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r[name])
        first, last = tuple(rows[0].get("entry") or START), tuple(rows[0].get("leave") or START)
        states = best_states([_unpacked(r["matrix"]) for r in rows], first, last)
        kind = pa.list_(pa.int32())
        return pa.table({"key": [r["key"] for r in rows], name: pa.array([r[name] for r in rows], pa.int32()), "entry": pa.array(states[:-1], kind), "leave": pa.array(states[1:], kind)})

    return run


def _traced(model: str):
    def run(batches):
        c = codec(model)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [trace_back(c, r["body"], r["left"], r["cut"], None if r["k"] == 0 else tuple(r["entry"]), None if r["last"] else tuple(r["leave"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(ids, pa.binary())], ["key", "k", "ids"])

    return run


def _joined(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("k").to_pylist(), table.column("ids").to_pylist(), strict=True))
    return pa.table({"key": [table.column("key")[0].as_py()], "ids": pa.array([b"".join(x for _, x in rows)], pa.binary())})


def encode_giants(texts: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """(key, ids) of the rows (key, text), keys and texts without repetition, by the parallel scan."""
    chunks = staged(texts.mapInArrow(_chunks(model, chunk), _CHUNKS).repartition("key", "k"), "chunks")
    matrices = staged(chunks.mapInArrow(_matrices(model), "key string, k int, block int, matrix binary"), "matrices")
    blocks = matrices.groupBy("key", "block").applyInArrow(_block_product, "key string, block int, matrix binary")
    entering = blocks.groupBy("key").applyInArrow(_scan("block"), "key string, block int, entry array<int>, leave array<int>")
    inner = matrices.join(entering, ["key", "block"])
    states = inner.groupBy("key", "block").applyInArrow(_scan("k"), "key string, k int, entry array<int>, leave array<int>")
    traced = chunks.join(states, ["key", "k"]).mapInArrow(_traced(model), "key string, k int, ids binary")
    return traced.groupBy("key").applyInArrow(_joined, "key string, ids binary")


def _encode(model: str, keep: list[str], text_col: str):
    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in slices(batch, 64, GROUP_BYTES):
                ids = c.encode([t or "" for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in keep), pa.array(ids, pa.binary())], [*keep, "ids"])

    return run


def encode(docs: DataFrame, model: str, keep: list[str] | None = None, text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` of docs (all unless given) and ids: the text's piece ids, 32-bit little-endian.

    The ids are those the library gives for the same model. One row per row of
    docs; a null or empty text has no ids. Equal giant texts are encoded once.
    A kept column named ids gives way to the result.
    """
    keep = unlike(docs.columns if keep is None else keep, ["ids"])
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([fields[c] for c in keep] + [T.StructField("ids", T.BinaryType())])
    small, done = _parted(docs.select(*dict.fromkeys([*keep, text_col])), keep, text_col, model, giant, chunk)
    return small.mapInArrow(_encode(model, keep, text_col), schema).unionByName(done)


def _parted(rows: DataFrame, keep: list[str], text_col: str, model: str, giant: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows that are no giants, and the columns keep and ids of those that are."""
    large = F.coalesce(F.length(text_col), F.lit(0)) > giant
    own = free_name("_key", rows.columns)
    giants = rows.filter(large).withColumn(own, F.sha2(F.col(text_col), 256))
    found = encode_giants(giants.select(F.col(own).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"]), model, chunk)
    done = giants.select(*keep, own).join(found.withColumnRenamed("key", own), own).select(*keep, "ids")
    return rows.filter(~large), done


def _decode(model: str, keep: list[str]):
    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in slices(batch, 64, GROUP_BYTES):
                texts = c.decode([b or b"" for b in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def decode(rows: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of rows (all unless given) and decoded: the text of the column ids; null ids give an empty text.

    Rows that repeat ids have equal results, an empty table gives an empty one,
    a list of any length is decoded whole. A kept column named decoded gives way
    to the result; other columns are not read.
    """
    keep = unlike(rows.columns if keep is None else keep, ["decoded"])
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([fields[c] for c in keep] + [T.StructField("decoded", T.StringType())])
    return rows.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(_decode(model, keep), schema)


def _digest(model: str, known: bool):
    """Digests of texts and of what comes back from their ids, a few texts at a time; ids are made here unless known."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in slices(batch, 64, GROUP_BYTES):
                texts = part.column("text").to_pylist()
                ids = part.column("ids").to_pylist() if known else c.encode(texts)
                back = c.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(b) // 4 for b in ids], pa.int64()),
                        pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    return run


def digests(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and round_trip (whether the text came back) of every text (null: empty).

    What encode() and decode() give, in one pass where texts are no giants, so
    that a task needs one Python process. Rows that repeat a text have equal
    results, an empty table gives an empty one, other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    small, done = _parted(rows, ["doc_id", "text"], "text", model, giant, chunk)
    return small.mapInArrow(_digest(model, False), kinds).unionByName(done.mapInArrow(_digest(model, True), kinds))
