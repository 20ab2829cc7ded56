"""WARC archives without repeated payloads.

Headers (id, uri, digest, size) are shuffled by payload digest; of equal
payloads the record with the largest id stays a response and the others become
revisits, which refer to it and carry no payload. Archives are written by task
with fresh headers, a warcinfo record first and one gzip member a record, and
counted by a manifest. Reading parses the archives and joins revisits to their
responses by digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, join_hot, small, staged
from tidemark.llm.files import read_file, write_file

#: Compressed bytes after which an archive is closed.
FILE_BYTES = 16 << 20
LEVEL = 4
#: Header fields of the row's id and of the id of the row that a revisit refers to.
ROW, REFERS = "X-Row-ID", "X-Refers-To-Row-ID"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that are handed on at first, and at most, to unpack a member.
WINDOW = 1 << 10, 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(batches):
    for batch in batches:
        payloads = [(t or "").encode() for t in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), batch.column("uri"), pa.array([payload_digest(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64())], ["id", "key", "uri", "digest", "bytes"])


def _rows(pages: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(payload_col).alias("key"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).alias("html"))


def decide(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers (id, key, digest, bytes; uri too, if wanted) with keep: the id of the response that a revisit refers to, null for responses.

    Also, for revisits and the responses they refer to, target (the response's
    uri) and copies (how many rows have its id and payload); else both are null.
    Payloads of fewer than least_bytes bytes are never revisits. A row without
    id refers to a response with one, if its payload has any. Rows that repeat
    an id and a payload share one decision.
    """
    total = headers.count()
    large = headers.filter(F.col("bytes") >= least_bytes)
    # by id first: rows of one payload meet in one task as a sum for each task
    each = large.groupBy("digest", "id").agg(F.count("*").alias("copies"), (F.max("uri") if "uri" in headers.columns else F.lit(None).cast("string")).alias("uri"))
    top = F.max(F.struct("id", "copies", "uri"))
    winners = each.groupBy("digest").agg(top.alias("top"), F.sum("copies").alias("size")).filter("size > 1")
    winners = staged(winners.select("digest", F.col("top.id").alias("keep"), F.col("top.uri").alias("target"), F.col("top.copies").alias("copies"), "size", F.lit(True).alias("known")), "responses")
    both = join_hot(headers, winners, ["digest"], "size", total)
    own = (F.col("bytes") >= least_bytes) & F.col("known")
    keep = F.when(own & ~F.col("id").eqNullSafe(F.col("keep")), F.col("keep"))
    return both.select(*headers.columns, keep.alias("keep"), *[F.when(own, F.col(c)).alias(c) for c in ("target", "copies")])


def _gzip(head: list[str], block: bytes) -> bytes:
    lines = "\r\n".join([*head, f"Content-Length: {len(block)}"])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(lines.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def record(kind: str, name: str, row: int | None, uri: str, digest: str, payload: bytes | None, date: str, original: tuple[str | None, int | None, str] | None = None) -> bytes:
    """One WARC/1.1 record, as a gzip member. original: a revisit's response, by record id (if it has one of its own), row and uri."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    block = http + (b"Content-Length: %d\r\n" % len(payload) if payload is not None else b"") + b"\r\n" + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if row is not None:
        lines.append(f"{ROW}: {row}")
    if original is not None:
        response, refers, target = original
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {target}", f"WARC-Refers-To-Date: {date}"]
        lines += [f"WARC-Refers-To: <{response}>"] if response else []
        lines += [f"{REFERS}: {refers}"] if refers is not None else []
    return _gzip([*lines, "Content-Type: application/http;msgtype=response"], block)


def info(name: str, date: str, run: str) -> bytes:
    """The record at the head of an archive that describes it."""
    fields = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nisPartOf: {run}\r\ndescription: pages without repeated payloads\r\n"
    return _gzip(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], fields.encode())


def members(blob: bytes):
    """The gzip members of an archive, each unpacked, in time in proportion to its size."""
    whole, at = memoryview(blob), 0
    while at < len(whole):
        unpacker, parts, size = zlib.decompressobj(31), [], WINDOW[0]
        while not unpacker.eof:
            window = whole[at : at + size]
            if not window:
                raise ValueError("an archive ends within a record")
            parts.append(unpacker.decompress(window))
            at += len(window) - len(unpacker.unused_data)
            size = min(2 * size, WINDOW[1])
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def _write(folder: str, date: str, run_id: str):
    space = uuid.UUID(run_id)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        records: list[bytes] = []
        held = done = 0
        fresh = lambda *what: f"urn:uuid:{uuid.uuid5(space, '/'.join(map(str, what)))}"
        clean = lambda uri: "".join((uri or "").split())

        def close():
            nonlocal held
            head = info(fresh("info", part, done), date, run_id)
            name = write_file(folder, f"part-{part:06d}", ".warc.gz", b"".join([head, *records]))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], ["file", "n_records"])
            records.clear()
            held = 0
            return row

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "uri", "html", "keep", "target", "copies")), strict=True):
                key, uri, html, keep, target, copies = row
                payload = (html or "").encode()
                digest = payload_digest(payload)
                # a response that is referred to has an id that can be told from its row, if the row is one alone
                seen = keep is not None
                named = fresh("response", keep if seen else key, digest) if copies == 1 else None
                own = named if named and not seen else fresh("record", part, done)
                original = (named, keep, clean(target)) if seen else None
                records.append(record("revisit" if seen else "response", own, key, clean(uri), digest, None if seen else payload, date, original))
                held += len(records[-1])
                done += 1
                if held >= FILE_BYTES:
                    yield close()
        if records:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str | None = None) -> DataFrame:
    """Archives of pages under folder, without repeated payloads; the manifest (file, n_records: of pages).

    A null payload is empty, a null uri too; white space in a uri, which would
    break a header, is left out. No rows make no files. Other columns are not
    written; a payload of any length is one record. Records are dated ``date``
    (the time of this call) and have ids that no other run repeats. Rows that
    repeat the id and the payload of a response are responses all, and their
    revisits name the response by uri, date and row alone. Of rows that refer
    to others or are referred to, ids and uris are joined to the payloads.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = _rows(pages, id_col, uri_col, payload_col)
    headers = staged(rows.mapInArrow(_headers, "id long, key long, uri string, digest string, bytes long"), "headers")
    found = decide(headers, least_bytes).filter(F.col("copies").isNotNull())
    groups = found.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "keep", "target", "copies").distinct()
    groups = small(staged(groups, "groups"))
    placed = rows.join(groups, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    placed = placed.select("id", "uri", "html", "keep", "target", "copies")
    return staged(placed.mapInArrow(_write(folder, date, str(uuid.uuid4())), "file string, n_records long"), "manifest")


def _parse(folder: str, payloads: bool):
    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                for raw in members(read_file(folder, file)):
                    fields, payload = parse(raw)
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    row, refers, whole = fields.get(ROW.lower()), fields.get(REFERS.lower()), kind == "response"
                    rows.append((int(row) if row else None, kind, fields["warc-target-uri"], fields["warc-payload-digest"].removeprefix("sha1:"), len(payload) if whole else None, int(refers) if refers else None, payload.decode() if whole and payloads else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = ["id", "record_type", "uri", "digest", "bytes", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the manifest's archives: id, record_type, uri, digest, bytes and payload (responses only), refers_to.

    A record whose page had no id or url has nulls there; one without a payload
    has 0 bytes. Records that repeat one another are all read; an empty manifest gives an empty result.
    """
    parts = max(1, min(int(manifest.count()), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("file").repartition(parts).mapInArrow(_parse(folder, payloads), "id long, record_type string, uri string, digest string, bytes long, refers_to long, payload string")


def resolve(records: DataFrame) -> DataFrame:
    """records with revisits joined to their responses by payload digest: bytes, and refers_to if it was not given.

    Of several responses of a digest the largest id is taken. A revisit whose
    response is not among records, or whose digest is null, keeps null bytes and
    what refers_to it had; an empty table gives an empty result.
    """
    heads = staged(records.select("id", "record_type", "uri", "digest", "bytes", "refers_to"), "records")
    total = heads.count()
    whole = F.col("record_type") == "response"
    known = heads.groupBy("digest").agg(F.max(F.when(whole, F.col("bytes"))).alias("full"), F.max(F.when(whole, F.col("id"))).alias("response"), F.count("*").alias("size"))
    both = join_hot(heads.filter(~whole), staged(known.filter("size > 1"), "known"), ["digest"], "size", total)
    revisits = both.select("id", "record_type", "uri", "digest", F.col("full").alias("bytes"), F.coalesce("refers_to", "response").alias("refers_to"))
    return heads.filter(whole).unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of pages in the shared folder, and what is read back and resolved from them."""
    folder = fresh_path(pages.sparkSession, "warc")
    return resolve(read_archives(write_archives(pages, folder), folder))
