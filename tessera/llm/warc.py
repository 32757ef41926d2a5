"""WARC: writing archives, and assembling the records of a capture through their concurrent-to identifiers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import _written, read, shared_dir

#: Least payload that a revisit record stands for.
REVISIT_BYTES = 1000
VERSION, END = b"WARC/1.0\r\n", b"\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest, bytes and refers_to of each row's payload.

    The payload is the html in UTF-8, a null one empty. Among rows with one payload of REVISIT_BYTES or more, those
    with the largest page_id are responses (refers_to null), the others refer to it. A row without page_id refers to
    the largest one there is, or is a response. Payloads are told apart by SHA-1 and length.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    shared = keys.where(F.col("bytes") >= REVISIT_BYTES).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(shared, F.col("digest") == F.col("of"), "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.select("page_id", "url", "payload", "digest", "bytes", refers.alias("refers_to"))


def _record(kind: str, rid: str, url: str, block: bytes, **more: str) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {url}"] if url else []
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three records for each row: request, response or revisit, metadata. A line end cannot stand in a header."""
    part = uuid.uuid4().hex
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out: list[bytes] = []
            for r in batch.slice(at, 64).to_pylist():
                n += 1
                ids = [uuid.uuid5(_SPACE, f"{part}/{n}/{k}") for k in ("request", "response", "metadata")]
                url = " ".join((r["url"] or "").split())
                path = "/" + url.partition("://")[2].partition("/")[2] if url else "/"
                host = url.partition("://")[2].partition("/")[0]
                ask = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
                page = "" if r["page_id"] is None else str(r["page_id"])
                about = f"pageId: {page}\r\npayloadBytes: {r['bytes']}\r\n".encode()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
                same = {"WARC_Payload_Digest": f"sha1:{r['digest']}"}
                if r["refers_to"] is None:
                    main = _record("response", ids[1], url, http + r["payload"], Content_Type="application/http; msgtype=response", **same)
                else:
                    main = _record("revisit", ids[1], url, http, Content_Type="application/http; msgtype=response", WARC_Profile=_REVISIT, WARC_Refers_To_Page=str(r["refers_to"]), **same)
                to = {"WARC_Concurrent_To": f"<urn:uuid:{ids[1]}>"}
                out.append(_record("request", ids[0], url, ask, Content_Type="application/http; msgtype=request", **to))
                out.append(main)
                out.append(_record("metadata", ids[2], url, about, Content_Type="application/warc-fields", **to))
            yield pa.RecordBatch.from_arrays([pa.array([VERSION + x for x in out], pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str) -> None:
    """WARC 1.0 files, one gzip stream each, under path: request, response or revisit, and metadata of each row.

    Spark's own text writer lays the records down (their bytes as they are, two line ends after each), so path may
    be in any store that Spark writes, and a lost executor's files are written again by another.
    """
    records = revisits(pages).mapInArrow(_write, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _parse(payloads: bool):
    """Records from the pieces between version lines; a piece shorter than its Content-Length goes on in the next."""

    def parsed(piece: bytes) -> tuple | None:
        head, _, block = piece.partition(END)
        h = _headers(head)
        length = int(h.get("content-length", "0"))
        if len(block) < length:
            return None
        block = block[:length]
        kind = h.get("warc-type", "")
        payload = block.partition(END)[2] if kind in ("request", "response", "revisit") else block
        full = payload if kind != "revisit" else None
        digest = hashlib.sha1(full).hexdigest() if full is not None else h.get("warc-payload-digest", "").removeprefix("sha1:").lower()
        ident = h.get("warc-record-id", "")
        return (kind, ident, h.get("warc-concurrent-to", ident), h.get("warc-target-uri"), list(h.items()), digest, None if full is None else len(full), payload if payloads or kind == "metadata" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = b"", None
        for batch in batches:
            out = []
            for f, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and f != file:
                    raise ValueError(f"a record in {file} ends before its Content-Length")
                if held:
                    piece = held + VERSION + piece
                held, file = b"", f
                if not piece:
                    continue
                got = parsed(piece)
                if got is None:
                    held = piece
                else:
                    out.append(got)
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        if held:
            raise ValueError(f"a record in {file} ends before its Content-Length")

    kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary()]
    names = ["kind", "record_id", "capture_id", "url", "headers", "digest", "bytes", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each WARC record under path: kind, record_id, capture_id, url, headers, digest, bytes, payload.

    Files are gzip streams or plain; a gzip file is read by one task as a stream, so no file is held in memory.
    Records are cut by Content-Length: a payload may hold version lines. digest is the SHA-1 of the payload read, for
    a revisit that of its header. With payloads=False the payloads are digested, but only metadata is kept.
    """
    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.input_file_name().alias("f"), F.col("value").cast("binary").alias("v"))
    schema = "kind string, record_id string, capture_id string, url string, headers map<string,string>, digest string, bytes bigint, payload binary"
    return lines.mapInArrow(_parse(payloads), schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, request, response, metadata.

    Request and metadata records name the response or revisit they are concurrent to, which is the capture; what a
    capture lacks is null, and of repeated records the one with the smallest identifier stays.
    """
    parts = F.struct("record_id", "kind", "url", "digest", "bytes", "payload", "headers")
    one = lambda *kinds: F.min_by(F.when(F.col("kind").isin(*kinds), parts), F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    return records.groupBy("capture_id").agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}"
    _written.append((spark, path))
    write_archives(read(spark, sf_dir, "pages"), path)
    captures = assemble(read_archives(spark, path, payloads=False))
    fields = F.str_to_map(F.col("metadata.payload").cast("string"), F.lit("\r\n"), F.lit(": "))
    number = lambda c: F.when(c != "", c).cast("long")
    return captures.select(
        number(fields["pageId"]).alias("page_id"),
        F.coalesce("response.bytes", fields["payloadBytes"].cast("long")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.element_at("response.headers", "warc-refers-to-page").cast("long").alias("refers_to"),
    )


SQL = f"""
with p as (select page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n, max(page_id) over (partition by coalesce(html, '')) last from pages)
select page_id, cast(n as bigint) payload_bytes, sha1(h) payload_digest,
  case when n >= {REVISIT_BYTES} and page_id <> last then 'revisit' else 'response' end record_type,
  case when n >= {REVISIT_BYTES} and page_id <> last then last end refers_to
from p"""
