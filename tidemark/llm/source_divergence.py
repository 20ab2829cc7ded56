"""Source divergence audit: how far the sources of a language differ in the terms that they use.

Documents are counted where they lie, by SQL in a DuckDB connection of the task,
and the counts are dealt to shards by a hash of language and term, sorted by them.
A shard works through its terms some at a time, again by vectorized SQL: sums of
counts, which terms to keep, then for each two sources a partial sum of the
divergence. Spark merges the shards' sums and ranks them.

A pair's divergence runs over all kept terms of its language, most of which
neither source has. With p(c) of a count c and z = p(0), the sum over all terms of
f(p, q) is

    V f(z, z')  +  sum over one's terms of f(p, z') - f(z, z')  +  the same of the other's
    +  sum over the terms of both of f(p, q) - f(p, z') - f(z, q) + f(z, z')

so shards join only sources that have a term in common, and the terms of one
source go into the sum by how many have each p. All of it is whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import slices, small, staged, text_bytes

LEAST_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Rows of counts that a task holds before it passes them on, and that a shard works on at once, whole terms each.
HELD_ROWS = 300_000
MEMORY = "400MB"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TABLE = np.frombuffer(_LETTERS, np.uint8)


def connection():
    """A DuckDB connection of one task: one thread, bounded memory, nothing on local disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})


def _asked(con, sql: str, **tables: pa.Table) -> pa.Table:
    for name, table in tables.items():
        con.register(name, table)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def _terms(texts: pa.Array) -> pa.Table:
    """(doc, term) of each term of each text: runs of ASCII letters, A-Z lower-cased, and of all characters beyond ASCII."""
    data, offsets = text_bytes(texts)
    data = _TABLE[data].tobytes()
    clean = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(clean)
    return pa.table({"doc": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})


_COUNT = """
WITH d AS (SELECT doc, term, count(*) AS n FROM terms WHERE term <> '' GROUP BY doc, term)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM d JOIN docs USING (doc) GROUP BY lang, source, term
"""
_MERGE = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY lang, source, term"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches):
    """Counts of a task's documents by lang, source and term, merged as far as HELD_ROWS go."""
    con, held = connection(), []
    for batch in (part for whole in batches for part in slices(whole, 4096, 4 << 20)):
        docs = pa.table({"doc": pa.array(range(batch.num_rows), pa.int64()), "lang": batch.column("lang"), "source": batch.column("source")})
        held.append(_asked(con, _COUNT, terms=_terms(batch.column("text")), docs=docs).cast(_COUNTS))
        if sum(t.num_rows for t in held) > HELD_ROWS:
            held = [_asked(con, _MERGE, counts=pa.concat_tables(held)).cast(_COUNTS)]
            if held[0].num_rows > HELD_ROWS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _asked(con, _MERGE, counts=pa.concat_tables(held)).cast(_COUNTS).to_batches()


def _whole_terms(batches, merge=None):
    """A shard's rows, sorted by lang and term, in tables of about HELD_ROWS rows that end between terms; merge makes one term's rows fewer."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < HELD_ROWS:
            continue
        table = pa.concat_tables(held)
        same = pc.and_(pc.equal(table["lang"], table["lang"][-1]), pc.equal(table["term"], table["term"][-1]))
        cut = pc.index(same, pa.scalar(True)).as_py()
        if cut:
            yield table.slice(0, cut)
        table = table.slice(cut)
        held = [merge(table) if merge and table.num_rows >= HELD_ROWS else table]
        rows = held[0].num_rows
    if held:
        yield pa.concat_tables(held)


def _kept(least_docs: int):
    """By shard: the counts of the terms that a language keeps, the language's own count, and a mark on one row of each term."""
    sql = f"""
    WITH c AS ({_MERGE}), k AS (SELECT lang, term, sum(n)::BIGINT AS in_lang, min(source) AS one FROM c GROUP BY lang, term HAVING sum(docs) >= {least_docs})
    SELECT lang, source, term, n, in_lang, (source = one)::BIGINT AS marked FROM c JOIN k USING (lang, term)
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("in_lang", pa.int64()), ("marked", pa.int64())])

    def run(batches):
        con = connection()
        for table in _whole_terms(batches, lambda t: _asked(con, _MERGE, counts=t).cast(_COUNTS)):
            yield from _asked(con, sql, counts=table).cast(schema).to_batches()

    return run


_F = "(({0}) - ({1})) * (({0}) - ({1})) // (({0}) + ({1}))"
_PAIRS = f"""
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.z")} - {_F.format("a.z", "b.p")} + {_F.format("a.z", "b.z")})::BIGINT AS value, NULL::BIGINT AS p
FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
"""
_ONE = "SELECT 'one' AS part, lang, source, NULL::VARCHAR AS item, count(*)::BIGINT AS value, p FROM s GROUP BY lang, source, p"
_TERMS = f"""
SELECT 'term' AS part, lang, source, term AS item, {_F.format("p", "q")} AS value, NULL::BIGINT AS p
FROM s WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {{top}}
"""
_PART = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("p", pa.int64())])


def _sums(top: int):
    """By shard: partial pair sums, terms of each source by p, and the best terms of each source."""
    share = "(1 + {scale}::HUGEINT * ({n} + 2) // ({of} + 2 * v::HUGEINT))::BIGINT"
    first = f"SELECT lang, source, term, {share.format(scale=SCALE, n='n', of='own')} AS p, {share.format(scale=SCALE, n='0', of='own')} AS z, {share.format(scale=SCALE, n='in_lang', of='all_own')} AS q FROM counts"

    def run(batches):
        con = connection()
        for table in _whole_terms(batches):
            s = _asked(con, first, counts=table)
            for sql in (_PAIRS, _ONE, _TERMS.format(top=top)):
                yield from _asked(con, sql, s=s).cast(_PART).to_batches()

    return run


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """How far the sources of each language are from one another, and by which terms each stands out.

    A language keeps the terms that are in at least least_docs of its
    documents. With V kept terms, a count c of a term among N in all gives
    p = 1 + floor(1e9 (c + 2) / (N + 2 V)); two such p differ by
    f = floor((p - q)^2 / (p + q)). Returns lang, source, part, item, value, rank:
    part ``pair`` has a row for each other source of the language (item), its
    value f summed over all kept terms; part ``term`` the top kept terms that the
    source has and uses more than the language does, by f against the
    language's p. rank counts from 1 in each source and part, the largest value
    first, then the least item by its UTF-8 bytes.

    Null texts, languages and sources count as ''. A source without a term
    is compared like any other; without kept terms pairs have value 0. Rows that
    repeat a document count as documents of their own. An empty table gives an
    empty result; a text of any length is read whole; further columns are not read.
    All arithmetic is exact.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    by_term = found.repartition("lang", "term").sortWithinPartitions("lang", "term")
    counts = staged(by_term.mapInArrow(_kept(least_docs), "lang string, source string, term string, n long, in_lang long, marked long"), "counts")

    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    lang_sums = counts.groupBy("lang").agg(F.sum("n").alias("all_own"), F.sum("marked").alias("v"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(lang_sums, "lang", "left")
    groups = staged(groups.fillna(0, ["own", "all_own", "v"]).withColumn("z", 1 + F.coalesce(F.call_function("div", F.lit(2 * SCALE), F.nullif(F.col("own") + 2 * F.col("v"), F.lit(0))), F.lit(0))), "groups")

    shards = counts.join(small(groups.drop("z")), ["lang", "source"]).repartition("lang", "term").sortWithinPartitions("lang", "term")
    parts = staged(shards.mapInArrow(_sums(top), "part string, lang string, source string, item string, value long, p long"), "parts")

    other = small(groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y")))
    level = _f(F.col("z"), F.col("y"))
    base = groups.join(other, "lang").filter("source < item").select("lang", "source", "item", (F.col("v") * level).alias("value"))
    one = parts.filter("part = 'one'").groupBy("lang", "source", "p").agg(F.sum("value").alias("k")).join(small(groups.select("lang", "source", "z")), ["lang", "source"])
    one = one.join(other, "lang").filter("source <> item").select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("k") * (_f(F.col("p"), F.col("y")) - level)).alias("value"))
    both = parts.filter("part = 'pair'").select("lang", "source", "item", "value")
    sums = base.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = parts.filter("part = 'term'").select("lang", "source", "part", "item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
