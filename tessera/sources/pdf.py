"""Pages of PDF files as rows (path, page, text).

The optional package pypdf reads them where it is installed. Elsewhere a small reader of its own takes the page tree,
plain or deflated content streams and object streams, and the strings that text operators show, read as Latin-1; fonts
with encodings of their own, encryption and other filters are beyond it and raise an error.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s\[\]()<>]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
# What an escaped letter stands for.
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    plain = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _LETTERS.get(m[1], m[1]), token[1:-1])
    return plain.decode("latin-1")


def _shown(content: bytes) -> str:
    """The strings of a page's text operators; a move to another line is a line end."""
    out: list[str] = []
    held: list[bytes] = []
    for token in _TOKEN.findall(content):
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"') and out:
                out.append("\n")
            out += [_string(t) for t in held if t[:1] in b"(<"]
            held = []
        elif token in (b"Td", b"TD", b"T*", b"Tm") and out:
            if out[-1] != "\n":
                out.append("\n")
            held = []
        else:
            held.append(token)
    return "".join(out).rstrip("\n")


def _own_pages(raw: bytes) -> list[str]:
    if b"/Encrypt" in raw:
        raise ValueError("the file is encrypted: install pypdf to read it")
    objects = {int(n): body for n, body in _OBJECT.findall(raw)}

    def stream(body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        head = body[: found.start()]
        if b"/Filter" in head and not re.search(rb"/Filter\s*\[?\s*/FlateDecode\s*\]?", head):
            raise ValueError("a stream has another filter than FlateDecode: install pypdf to read it")
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)  # else the number is in another object
        data = body[found.start(1) : found.start(1) + int(size[1])] if size else found[1]
        return zlib.decompressobj().decompress(data) if b"/FlateDecode" in head else data

    for body in [b for b in objects.values() if b"/ObjStm" in b]:
        data, count, first = stream(body), int(re.search(rb"/N\s+(\d+)", body)[1]), int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = list(map(int, data[:first].split()))[: 2 * count]
        ends = [*numbers[3::2], len(data) - first]
        for n, a, b in zip(numbers[::2], numbers[1::2], ends):
            objects.setdefault(n, data[first + a : first + b])
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    top = re.search(rb"/Pages\s+(\d+)", root) if root else None
    if not top:
        raise ValueError("no page tree found")
    pages: list[str] = []

    def walk(n: int, seen: frozenset[int]) -> None:
        body = objects.get(n, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            for k in _REF.findall(kids[1]):
                if int(k) not in seen:
                    walk(int(k), seen | {int(k)})
        else:
            at = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
            parts = [stream(objects.get(int(k), b"")) for k in _REF.findall(at[1])] if at else []
            pages.append(_shown(b"\n".join(parts)))

    walk(int(top[1]), frozenset())
    return pages


def pages_of(raw: bytes) -> list[str]:
    """The text of each page of a PDF."""
    try:
        import pypdf
    except ImportError:
        return _own_pages(raw)
    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages]


def pages(files: DataFrame) -> DataFrame:
    """(path, page, text) from rows (path, content), pages from 1; a file that cannot be read has one row, page null and its error as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                try:
                    texts = pages_of(content.as_py() or b"")
                    numbers = list(range(1, len(texts) + 1))
                except Exception as error:  # noqa: BLE001  one bad file must not end the scan of all
                    texts, numbers = [str(error)], [None]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(texts), pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["path", "page", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of the PDF files under path."""
    return pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path))


def contexts(rows: DataFrame, budget: int, most: int) -> DataFrame:
    """(path, pages, is_full, model_context): a file's pages within the budget of characters, else its first ``most`` pages."""
    marked = F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    good = rows.where("page is not null").withColumn("_m", marked)
    # only pages that can be shown are collected: the first ones, and, of a file within the budget, all
    sizes = good.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("pages"), (F.sum(F.length("_m")) + 2 * (F.count("*") - 1)).alias("_n"))
    some = good.join(sizes, F.col("path") == F.col("_p")).where((F.col("_n") <= budget) | (F.col("page") <= most))
    per = some.groupBy("path", "pages", "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_m"))), lambda x: x["_m"]), "\n\n").alias("_t"))
    full = F.col("_n") <= budget
    cut = F.concat(F.col("_t"), F.format_string("\n\n[Cut: %d of %d pages.]", F.least(F.col("pages"), F.lit(most).cast("long")), F.col("pages")))
    return per.select("path", "pages", full.alias("is_full"), F.when(full, F.col("_t")).otherwise(cut).alias("model_context"))
