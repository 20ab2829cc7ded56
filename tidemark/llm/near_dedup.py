"""Near-duplicate groups by b-bit MinHash.

Each text's set of word shingles gets HASHES minima. Bands of full minima give
candidates; of each minimum only the low BITS bits are kept, packed in long
words, and candidates are screened by counting equal b-bit groups with the
share of chance matches taken out. What passes is confirmed on full sets.

Equal sets are one class from the start. A bucket of n classes gives n - 1
candidates in a first round, each member with the one that meets most others.
Buckets that then still hold several components are compared whole, in one
task each (or in pairs of blocks), which gives only the links that join
components. So a large group of copies costs a number of rows in proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column_words, join_hot, mix64, one_of_each, slices, small, staged, word_hashes
from tidemark.llm.components import components

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Minima a set; BANDS * ROWS of them make bands, all of them the packed signature.
HASHES, BITS = 128, 4
#: Standard errors by which the estimate may fall short of the threshold: one true link in a million.
SLACK = 5.0
#: Classes of one bucket that one call compares; larger buckets are dealt out in pairs of such blocks.
BLOCK = 512
#: Stands for a null doc_id where ids are ordered: after all others.
NO_ID = 2**63 - 1

_GENERATOR = np.random.default_rng(7)
_A = _GENERATOR.integers(0, 2**32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)
_B = _GENERATOR.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)
_POWERS = [np.uint64(pow(0x9FB21C651E98DF25, k, 1 << 64)) for k in range(SHINGLE)]


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text from its words' hashes."""
    total = len(hashes) - SHINGLE + 1
    runs = np.zeros(0, np.uint64)
    if total > 0:
        runs = hashes[:total] * _POWERS[0]
        for k in range(1, SHINGLE):
            runs = runs + hashes[k : k + total] * _POWERS[k]
        runs = mix64(runs)
    out = []
    for at, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = end - at
        if n >= SHINGLE:
            x = runs[at : end - SHINGLE + 1].copy()
            x.sort()
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif n:
            whole = np.uint64(n)
            for k in range(n):
                whole = whole + hashes[at + k] * _POWERS[k]
            out.append(mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(out, (_A * x[None, k : k + 1024] + _B).min(axis=1), out=out)
    return out


def _pack(low: np.ndarray) -> np.ndarray:
    """Rows of HASHES minima as rows of 64-bit words with BITS bits of each."""
    per = 64 // BITS
    groups = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(groups << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _signatures(batches):
    for whole in batches:
        for batch in slices(whole):
            with np.errstate(over="ignore"):
                sets = shingle_sets(*column_words(batch.column("text")))
                mins = np.stack([minima(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix64(bands + mins[:, k : BANDS * ROWS : ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(1 << 40))
                packed = _pack(mins)
                same = [(int(np.bitwise_xor.reduce(mix64(s))), int(np.add.reduce(mix64(s ^ np.uint64(0x2545F4914F6CDD1D))))) for s in sets]
            live = np.array([len(s) > 0 for s in sets], bool)
            lists = lambda m: pa.array([r if ok else None for r, ok in zip(m.view(np.int64), live, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([f"{a:016x}{b:016x}" if ok else None for (a, b), ok in zip(same, live, strict=True)], pa.string()),
                    lists(bands),
                    lists(packed),
                ],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands", "packed"],
            )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of the whole set), bands, packed (b-bit minima); null keys for empty sets."""
    return _rows(docs, id_col, text_col).mapInArrow(_signatures, "doc_id long, text_key long, n_shingles long, set_key string, bands array<long>, packed array<long>")


def estimate(x: str, y: str):
    """Similarity from two packed signatures: matches counted by bits, chance matches of 2^-BITS taken out."""
    lanes = sum(1 << k for k in range(0, 64, BITS))
    lanes = lanes - (1 << 64) if lanes >= 1 << 63 else lanes

    def differ(a, b):
        z = a.bitwiseXOR(b)
        step = 1
        while step < BITS:
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
            step *= 2
        return F.bit_count(z.bitwiseAND(F.lit(lanes)))

    apart = F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda s, v: s + v)
    chance = 2.0**-BITS
    return ((1 - apart / F.lit(float(HASHES))) - chance) / (1 - chance)


def floor_of(percent: int) -> float:
    """The least estimate that goes on to confirmation, for a threshold in percent."""
    j, chance = percent / 100, 2.0**-BITS
    e = chance + (1 - chance) * j
    return j - SLACK * (e * (1 - e) / HASHES) ** 0.5 / (1 - chance)


def _confirm(percent: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                kept = []
                with np.errstate(over="ignore"):
                    mine = shingle_sets(*column_words(batch.column("text_a")))
                    last, other = object(), None
                    for k, text in enumerate(batch.column("text_b").to_pylist()):
                        if text is not last and text != last:
                            raw = np.frombuffer((text or "").encode(), np.uint8)
                            last, other = text, shingle_sets(*word_hashes(raw, np.array([0, len(raw)])))[0]
                        common = len(np.intersect1d(mine[k], other, assume_unique=True))
                        kept.append(100 * common >= percent * (len(mine[k]) + len(other) - common) and common > 0)
                out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
                yield out.filter(pa.array(kept, pa.bool_()))

    return run


def _class_texts(classes: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(cls, text) with the text of one document of each class."""
    need = small(staged(classes.join(reps.select("cls", F.col("least.doc").alias("doc"), F.col("least.text_key").alias("key")), "cls"), "need"))
    one = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")) & (F.col("text_key") == F.col("key"))
    return staged(rows.join(need, one).select("cls", "text").dropDuplicates(["cls"]), "texts")


def _confirmed(pairs: DataFrame, reps: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links: screened by estimate, confirmed on whole texts."""
    packed = reps.select("cls", "packed")
    near = (
        pairs.join(packed.select(F.col("cls").alias("a"), F.col("packed").alias("pa")), "a")
        .join(packed.select(F.col("cls").alias("b"), F.col("packed").alias("pb")), "b")
        .filter(estimate("pa", "pb") >= floor_of(percent))
        .select("a", "b")
    )
    near = staged(near, "near")
    some = _class_texts(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), reps, rows)
    both = near.join(some.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(some.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return staged(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long"), "links")


def _across(floor: float):
    """The classes of one bucket (or of two of its blocks) that by estimate may be linked to another component."""
    chance, lanes = 2.0**-BITS, np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    most = int(np.floor((1 - (floor * (1 - chance) + chance)) * HASHES))

    def run(table: pa.Table) -> pa.Table:
        comp, block = table.column("component").to_numpy(), table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sig = np.array(table.column("packed").to_pylist(), np.int64).view(np.uint64)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        meets = np.zeros(len(comp), bool)
        for i in left.tolist():
            others = right[comp[right] != comp[i]]
            z = sig[others] ^ sig[i]
            step = 1
            while step < BITS:
                z = z | (z >> np.uint64(step))
                step *= 2
            near = others[np.bitwise_count(z & lanes).sum(axis=1, dtype=np.int64) <= most]
            if len(near):
                meets[near] = meets[i] = True
        return table.filter(pa.array(meets)).drop_columns(["packed"])

    return run


def _sets(batches):
    for whole in batches:
        for batch in slices(whole):
            with np.errstate(over="ignore"):
                sets = shingle_sets(*column_words(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "shingles"])


def _join(percent: int):
    """Links between components of one bucket (or of two of its blocks), on whole sets; no more than it takes to join them."""

    def run(table: pa.Table) -> pa.Table:
        cls, comp, block = (table.column(c).to_numpy().copy() for c in ("cls", "component", "block"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        every, count = np.unique(np.concatenate(sets), return_counts=True)
        common = every[count > 1]
        bits = np.zeros((len(sets), -(-max(1, len(common)) // 64)), np.uint64)
        for k, x in enumerate(sets):  # a row of bits for each set, over the shingles that sets share
            at = np.searchsorted(common, x)
            own = np.zeros(bits.shape[1] * 64, bool)
            if len(common):
                own[at[(at < len(common)) & (common[np.minimum(at, len(common) - 1)] == x)]] = True
            bits[k] = np.packbits(own).view(np.uint64)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = []
        for i in left.tolist():
            others = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
            for k in range(0, len(others), 512):
                some = others[k : k + 512]
                shared = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64)
                for j in some[(shared > 0) & (100 * shared >= percent * (size[some] + size[i] - shared))].tolist():
                    if comp[j] != comp[i]:
                        found.append((max(cls[i], cls[j]), min(cls[i], cls[j])))
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _between(members: DataFrame, groups: DataFrame, reps: DataFrame, rows: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links between components that meet in a bucket; None if no bucket holds two.

    Pairs never leave the task that compares them: a first pass tells, by
    signature, which classes may have a link at all, a second one compares
    the whole sets of those.
    """
    named = members.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left")
    named = staged(named.withColumn("component", F.coalesce("component", "cls")), "named")
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    mixed = staged(mixed, "mixed")
    if mixed.isEmpty():
        return None
    share = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = (
        named.join(mixed, "bucket", "left_semi")
        .join(reps.select("cls", "packed"), "cls")
        .withColumn("block", F.pmod(F.xxhash64("cls"), share).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), share - 1)))
        .select("bucket", "cls", "component", "packed", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    kinds = "bucket long, cls long, component long, block int, lo int, hi int"
    live = staged(dealt.groupBy("bucket", "lo", "hi").applyInArrow(_across(floor_of(percent)), kinds), "live")
    sets = staged(_class_texts(live.select("cls").distinct(), reps, rows).mapInArrow(_sets, "cls long, shingles binary"), "sets")
    return staged(live.join(sets, "cls").groupBy("bucket", "lo", "hi").applyInArrow(_join(percent), "a long, b long").distinct(), "links")


def near_groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text), group_key (a number of the group, null for empty sets).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a
    text's set is its distinct SHINGLE-word shingles, or its whole sequence of
    words if there are fewer. Texts whose sets have a similarity of at least
    ``percent`` per cent are linked; component_id is the smallest doc_id
    reachable over links, and that row is kept.

    A null or empty text, or one of white space, has an empty set, is linked
    with nothing and kept. Rows with equal sets are always together; rows that
    repeat a doc_id count apart, and where the smallest doc_id of a group is
    repeated all its rows are kept. Rows with a null doc_id join groups by their
    text but never name one while the group has another; a group of such rows
    alone has a null component_id and its rows are kept. An empty table gives an
    empty result; a text of any length is read whole. Other columns are not
    read. A link is missed only if no band agrees (below 1e-6 at 85 per cent)
    or the estimate falls short by SLACK standard errors.

    Classes of one mixed bucket are compared in pairs of blocks: n of them make
    n * n / (2 * block * block) tasks of block * block comparisons each, so the work grows
    with the square of the different texts of one bucket, not of its copies.
    """
    sigs = staged(signatures(docs, id_col, text_col), "signatures")
    total = sigs.count()
    classes = sigs.filter(F.col("set_key").isNotNull()).groupBy("set_key")
    # sets are told apart by 128 bits of hash; a class is numbered, and the numbers hold once they are written
    classes = classes.agg(F.count("*").alias("size"), F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_key")).alias("least"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    reps = staged(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    banded = reps.select("cls", F.posexplode("bands").alias("band", "value")).select("cls", F.xxhash64("band", "value").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(banded.join(staged(sizes, "sizes"), "bucket"), "members")
    # a bucket's centre is the member that meets most others: of a group of copies, the text they come from
    degrees = staged(members.groupBy("cls").agg(F.sum("n").alias("degree")), "degrees")
    ranked = staged(members.join(degrees, "cls"), "ranked")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "cls")).alias("top")).select("bucket", F.col("top.cls").alias("centre"))
    stars = ranked.join(staged(centres, "centres"), "bucket").filter("cls <> centre")
    stars = stars.select(F.greatest("cls", "centre").alias("a"), F.least("cls", "centre").alias("b")).distinct()

    rows = _rows(docs, id_col, text_col)
    links = _confirmed(stars, reps, rows, percent)
    final = staged(components(links), "groups")
    more = _between(members, final, reps, rows, percent, block)
    if more is not None and not more.isEmpty():
        final = staged(components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "groups")

    table = reps.join(final.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    table = staged(table.select("set_key", "component", "size", "least"), "table")
    least = F.nullif(F.min("least.doc"), F.lit(NO_ID))
    names = table.groupBy("component").agg(least.alias("component_id"), F.count("*").alias("classes"))
    table = join_hot(table, staged(names, "names"), ["component"], "classes", total)
    table = staged(table.select("set_key", "size", "component_id", F.col("component").alias("group_key")), "table")
    both = join_hot(sigs.select("doc_id", "text_key", "n_shingles", "set_key"), table, ["set_key"], "size", total)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return both.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", "group_key")


def drop_near_copies(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group; all columns stay.

    That is the row with the smallest doc_id; where several rows have it, or all
    doc_ids of a group are null, the least of these rows by their columns. Texts
    without words are in no group and all stay.
    """
    groups = near_groups(docs, percent, id_col, text_col).select("doc_id", "text_key", "kept", "group_key")
    return one_of_each(docs, staged(groups, "decisions"), id_col, text_col)
