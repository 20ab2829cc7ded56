"""Helpers that several operators share: shared storage, hashing of words, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key that holds one row in so many, or in 4 for each shuffle partition if that is more, is hot; at most so many keys can be.
HOT_SHARE = 1000
#: Rows of a few numbers and short strings that may be broadcast (some 100 MB); beyond that they are shuffled.
BROADCAST_ROWS = 2_000_000
#: Folders that this session has written and not cleared.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent a temporary folder is set, but only if driver
    and executors are one machine; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete what operators of this session have left in the shared folder, and say how many folders that was.

    For after results are written: tables that operators have returned read
    these folders and can't be read any more.
    """
    jvm = spark.sparkContext._jvm
    count = len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, to be broadcast if it has no more than so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


def unlike(names: list[str], taken: list[str]) -> list[str]:
    """Those of names that none of taken has, letter case aside."""
    lower = {t.lower() for t in taken}
    return [n for n in names if n.lower() not in lower]


def free_name(stem: str, names: list[str]) -> str:
    """stem, with as many underscores after it as it takes to differ from all names."""
    while not unlike([stem], names):
        stem += "_"
    return stem


def one_of_each(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that decisions (doc_id, text_key, kept, group_key) lets go, and one row of each group.

    Where a group keeps several rows because they repeat its doc_id, the least
    of them by their columns stays. Rows without a group_key all stay. What goes
    is joined by id and hash of the text, broadcast if it is few rows; beyond
    that whole rows are shuffled.
    """
    doc, key, group, row = (free_name(n, docs.columns) for n in ("_doc", "_key", "_group", "_row"))
    named = [F.col("doc_id").alias(doc), F.col("text_key").alias(key)]
    same = F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & F.xxhash64(text_col).eqNullSafe(F.col(key))
    left = docs.join(small(staged(decisions.filter(~F.col("kept")).select(*named).distinct(), "gone")), same, "left_anti")
    kept = decisions.filter(F.col("kept") & F.col("group_key").isNotNull())
    many = kept.groupBy("group_key").count().filter("count > 1").select("group_key")
    twins = staged(kept.join(many, "group_key", "left_semi").select(*named, F.col("group_key").alias(group)).distinct(), "twins")
    if twins.isEmpty():
        return left
    marked = left.join(small(twins), same, "left")
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = marked.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(whole, F.struct(*order)).alias(row)).select(f"{row}.*")
    return marked.filter(F.col(group).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined with table on keys, where a few keys may hold most of the rows.

    table has one row per key and in ``size`` the number of rows of that key.
    Keys that hold at least one row in ``share`` are at most so many, so that
    part of table is broadcast; the other keys are shuffled.
    """
    share = max(HOT_SHARE, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = max(2, total // share + 1)
    others = [c for c in table.columns if c not in keys]
    hot = table.filter(F.col(size) >= limit).withColumn("_hot", F.lit(True))
    hot = hot.select(*keys, "_hot", *[F.col(c).alias(f"_h_{c}") for c in others])
    both = rows.join(F.broadcast(hot), keys, "left")
    wide = [F.col(c) for c in rows.columns]
    light = both.filter(F.col("_hot").isNull()).select(*wide).join(table.filter(F.col(size) < limit), keys, "left")
    heavy = both.filter(F.col("_hot").isNotNull()).select(*wide, *[F.col(f"_h_{c}").alias(c) for c in others])
    return heavy.unionByName(light.select(*rows.columns, *others))


# --- words and their hashes ------------------------------------------------

_CHUNK = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLES: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _tables() -> dict:
    if not _TABLES:
        letters = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        letters[65:91] = letters[97:123]  # A-Z count as a-z
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        base = 0xD6E8FEB86659FD93
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(_CHUNK + 1, base, np.uint64), np.full(_CHUNK + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        _TABLES.update(letters=letters, space=space, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _TABLES


def _hash_block(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in data; first marks bytes that begin a text."""
    t = _tables()
    space = t["space"][data]
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    ends = ~space
    ends[:-1] &= space[1:] | first[1:]
    stops = np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(t["letters"][data] * t["up"][: len(data)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * t["down"][starts]), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of many texts, A-Z lower-cased.

    data: the UTF-8 bytes of the texts, one after the other; text i is
    data[offsets[i]:offsets[i + 1]]. Returns the hashes and, per text, where its
    words begin among them. Works through pieces of 64 KB that end
    between words; one longer word is hashed by the hashes of its pieces.
    """
    hashes, places = [], []
    edges = np.asarray(offsets, np.int64)
    space = _tables()["space"]
    at, end = int(edges[0]), int(edges[-1])
    while at < end:
        stop = min(end, at + _CHUNK)
        if stop < end:
            k = int(np.searchsorted(edges, stop, "right")) - 1
            cut = int(edges[k])
            if cut <= at:  # inside one text: cut after the last space of the piece
                gaps = np.flatnonzero(space[data[at:stop]])
                if len(gaps):
                    cut = at + int(gaps[-1]) + 1
                else:
                    h, stop = _long_word(data, at, int(edges[k + 1]), space)
                    hashes.append(np.array([h], np.uint64))
                    places.append(np.array([at], np.int64))
                    at = stop
                    continue
            stop = cut
        first = np.zeros(stop - at, bool)
        inner = edges[np.searchsorted(edges, at) : np.searchsorted(edges, stop)] - at
        first[inner] = True
        h, s = _hash_block(data[at:stop], first)
        hashes.append(h)
        places.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), edges).astype(np.int64)


def _long_word(data: np.ndarray, at: int, limit: int, space: np.ndarray) -> tuple[np.uint64, int]:
    total, stop = np.uint64(0x5851F42D4C957F2D), at
    with np.errstate(over="ignore"):
        while stop < limit and not space[data[stop]]:
            piece = data[stop : min(limit, stop + _CHUNK)]
            gaps = np.flatnonzero(space[piece])
            piece = piece[: int(gaps[0])] if len(gaps) else piece
            h, _ = _hash_block(piece, np.zeros(len(piece), bool))
            total = mix64(np.array([total * _ODD + h[0]], np.uint64))[0]
            stop += len(piece)
    return total, stop


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*text_bytes(column))


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 2 << 20):
    """batch in pieces of a bounded number of rows, and of about so many bytes if they have several rows."""
    if batch.num_rows <= rows and batch.nbytes <= size:
        if batch.num_rows:
            yield batch
        return
    each = sum(_row_bytes(c) for c in batch.columns) if batch.num_rows else np.zeros(0)
    start, held = 0, 0.0
    for k, n in enumerate(each.tolist()):
        if k > start and (k - start >= rows or held + n > size):
            yield batch.slice(start, k - start)
            start, held = k, 0.0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # what earlier batches took


def _row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a column, about."""
    wide = {pa.string(): np.int32, pa.binary(): np.int32, pa.large_string(): np.int64, pa.large_binary(): np.int64}.get(column.type)
    if wide is not None and len(column):
        return np.diff(np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]).astype(np.float64)
    return np.full(len(column), column.nbytes / max(1, len(column)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
