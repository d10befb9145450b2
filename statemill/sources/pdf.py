"""Vector PDFs: a small reader of text operators, behind Spark's binary files.

It reads uncompressed and Flate-compressed content streams, text placed by Tm, Td, TD and T*, and strings in the standard
encodings; fonts with their own encodings and encrypted files are out of its reach and give an error column, not a failure.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

SPAN_SCHEMA = "doc_id string, page int, span int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, page_w double, page_h double, error string"

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        hexed = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((hexed + b"0" * (len(hexed) % 2)).decode()).decode("latin-1")
    out = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return out.decode("latin-1")


def _objects(data: bytes) -> dict[int, bytes]:
    return {int(m[1]): m[3] for m in _OBJECT.finditer(data)}


def _stream(body: bytes) -> bytes:
    m = _STREAM.match(body)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]


def page_spans(content: bytes, height: float):
    """(text, x0, y0, x1, y1, size) with y downwards from the page's top; widths are taken as half the size for a character."""
    size, lead, x, y, lx, ly, stack = 12.0, 0.0, 0.0, 0.0, 0.0, 0.0, []
    for raw in _TOKEN.findall(content):
        if raw[:1] in b"(<[]/+-.0123456789":
            stack.append(raw)
            continue
        nums = [float(s) for s in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", s)]
        if raw == b"BT":
            x = y = lx = ly = 0.0
        elif raw == b"Tf" and nums:
            size = nums[-1]
        elif raw == b"TL" and nums:
            lead = nums[-1]
        elif raw == b"Tm" and len(nums) >= 6:
            x, y = lx, ly = nums[-2:]
        elif raw in (b"Td", b"TD") and len(nums) >= 2:
            lx, ly = lx + nums[-2], ly + nums[-1]
            x, y, lead = lx, ly, -nums[-1] if raw == b"TD" else lead
        elif raw == b"T*" or raw in (b"'", b'"'):
            ly -= lead
            x, y = lx, ly
        if raw in (b"Tj", b"TJ", b"'", b'"'):
            text = "".join(_string(s) for s in stack if s[:1] in b"(<")
            width = 0.5 * size * len(text)
            if text:
                yield text, x, height - y - size, x + width, height - y, size
            x += width
        stack = []


def read_pdf(data: bytes):
    """Rows (page, span, text, box, size, page size, error) of one file; a broken file gives one row with its error."""
    try:
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        objects = _objects(data)
        pages = [(k, b) for k, b in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
        if not pages:
            raise ValueError("no pages")
        kids = [int(k) for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b) for k in _REF.findall(b.partition(b"/Kids")[2].partition(b"]")[0])]
        pages.sort(key=lambda p: kids.index(p[0]) if p[0] in kids else len(kids))
        for number, (_, body) in enumerate(pages):
            box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body) or re.search(rb"/MediaBox\s*\[([^\]]*)\]", data)
            w, h = [float(v) for v in box[1].split()][2:] if box else (595.0, 842.0)
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            content = b"\n".join(_stream(objects.get(int(k), b"")) for k in _REF.findall(refs[1])) if refs else b""
            spans = list(page_spans(content, h))
            for n, (text, *geo) in enumerate(spans):
                yield (number, n, text, *geo, w, h, None)
            if not spans:
                yield (number, None, None, None, None, None, None, None, w, h, None)
    except Exception as e:
        yield (None,) * 10 + (f"{type(e).__name__}: {e}",)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """All spans of the PDF files under ``path``; doc_id is the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        names = [f.strip().split(" ")[0] for f in SPAN_SCHEMA.split(",")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in read_pdf(bytes(content))], columns=names).astype({"page": "Int32", "span": "Int32"})

    return files.mapInPandas(run, SPAN_SCHEMA)


def read_pdf_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of vector PDFs, ready for ``plans.statement.process``; ``failed_files`` has the files that gave none."""
    from pyspark.sql import functions as F

    from .tables import reading_order, split_spans

    words = split_spans(read_spans(spark, path).where("text IS NOT NULL"))
    ordered = reading_order(words)
    return ordered.select("doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1", F.lit("DIGITAL").alias("mode"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("font_size"))


def failed_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, error) of the PDF files that cannot be read."""
    return read_spans(spark, path).where("error IS NOT NULL").select("doc_id", "error")


def page_facts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, page_w, page_h, words, images) for ``classify.route_pages``; image boxes are not read, so there are none."""
    from pyspark.sql import functions as F

    from .tables import split_spans

    spans = read_spans(spark, path).where("error IS NULL")
    words = split_spans(spans.where("text IS NOT NULL")).groupBy("doc_id", "page").agg(F.collect_list("text").alias("words"))
    sizes = spans.groupBy("doc_id", "page").agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
    return sizes.join(words, ["doc_id", "page"], "left").withColumns({"words": F.coalesce("words", F.array().cast("array<string>")), "images": F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")})
