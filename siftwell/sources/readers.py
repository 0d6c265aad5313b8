"""Files to blocks: (doc_id, pos, type, content, source_file, error). Formats are told by extension; a file that fails keeps a row with its error."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by format.
FORMATS = {"pdf": ("pdf",), "docx": ("docx", "doc"), "excel": ("xlsx", "xls"), "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"), "text": ("txt", "md", "rst")}
BLOCKS = "doc_id string, pos int, type string, content string, source_file string, error string"
Parser = Callable[[str, bytes], list[tuple[str, str]]]


def file_format(path: Column) -> Column:
    """The format of a path; null for one that no parser supports."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, exts in FORMATS.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one block each."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("source_file"))
    doc = F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(doc.alias("doc_id"), F.lit(0).alias("pos"), F.lit("text").alias("type"), "content", "source_file", F.lit(None).cast("string").alias("error"))


def docx(path: str, data: bytes) -> list[tuple[str, str]]:
    """Paragraphs that aren't blank, then tables, cells joined by | and rows by line ends."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    paras = [("text", s) for p in body.findall(f"{w}p") if (s := said(p)).strip()]
    tables = [("table", "\n".join(" | ".join(said(c).strip() for c in r.findall(f"{w}tc")) for r in t.findall(f"{w}tr"))) for t in body.findall(f"{w}tbl")]
    return paras + tables


def xlsx(path: str, data: bytes) -> list[tuple[str, str]]:
    """A markdown table for each sheet."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{m}si")]
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for r in ElementTree.fromstring(z.read(name)).iter(f"{m}row"):
            cells = []
            for c in r.findall(f"{m}c"):
                v = c.find(f"{m}v")
                s = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else "" if v is None else v.text or ""
                cells.append(shared[int(s)] if c.get("t") == "s" and s else s)
            rows.append(cells)
        if rows:
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append(("table", "\n".join([lines[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *lines[1:]])))
    return out


def image(path: str, data: bytes) -> list[tuple[str, str]]:
    return [("image", path)]


def plain(path: str, data: bytes) -> list[tuple[str, str]]:
    return [("text", data.decode("utf-8"))]


def parsers(pdf: Parser | None = None) -> dict[str, Parser]:
    """Parsers by format; one for PDF is injected, as none is part of the standard library."""
    return {"docx": docx, "excel": xlsx, "image": image, "text": plain} | ({"pdf": pdf} if pdf else {})


def first_of(*tried: Parser) -> Parser:
    """A parser that takes the first of several that doesn't fail, such as a plain one after one for layouts."""

    def run(path: str, data: bytes) -> list[tuple[str, str]]:
        for p in tried[:-1]:
            try:
                return p(path, data)
            except Exception:
                continue
        return tried[-1](path, data)

    return run


def folder(spark: SparkSession, path: str, recursive: bool = True, use: dict[str, Parser] | None = None, converted: str | None = None) -> DataFrame:
    """Every supported file of a folder, parsed where it is read; what `converted`, a folder of text files, has a document of is taken from there and not parsed."""
    use = use or parsers()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.select("path", "content", file_format(F.col("path")).alias("format")).where("format is not null")
    ready = text(spark, converted) if converted else None
    if ready is not None:
        doc = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        files = files.withColumn("_doc", doc).join(ready.select(F.col("doc_id").alias("_doc")).distinct(), "_doc", "left_anti").drop("_doc")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data, f in zip(b["path"], b["content"], b["format"], strict=True):
                doc = re.sub(r"\.[^./]*$", "", p.rsplit("/", 1)[-1])
                try:
                    if f not in use:
                        raise ValueError(f"no parser for {f}")
                    rows += [(doc, k, kind, s, p, None) for k, (kind, s) in enumerate(use[f](p, data))]
                except Exception as e:
                    rows.append((doc, -1, None, None, p, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "pos", "type", "content", "source_file", "error"]).astype(object)

    parsed = files.mapInPandas(part, BLOCKS)
    return parsed if ready is None else parsed.unionByName(ready)


def image_header(data: bytes) -> tuple[str | None, int | None, int | None, str | None]:
    """(format, width, height, mode) by an image file's header; nulls for what is none of PNG, GIF, BMP and JPEG."""
    # Colour types of PNG, and component counts of JPEG.
    png = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
    jpeg = {1: "L", 3: "RGB", 4: "CMYK"}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        w, h, _, kind = struct.unpack(">IIBB", data[16:26])
        return "PNG", w, h, png.get(kind)
    if data[:3] == b"GIF" and len(data) >= 10:
        return "GIF", *struct.unpack("<HH", data[6:10]), "P"
    if data[:2] == b"BM" and len(data) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return "BMP", w, abs(h), "RGB" if bits >= 24 else "P"
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w, n = struct.unpack(">HHB", data[at + 5 : at + 10])
                return "JPEG", w, h, jpeg.get(n)
            at += 2 + size
        return "JPEG", None, None, None
    return None, None, None, None


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, width, height, mode) of image files, read from their headers where they lie."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame([(p, *image_header(d)) for p, d in zip(b["path"], b["content"], strict=True)], columns=["path", "format", "width", "height", "mode"]).astype(object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(file_format(F.col("path")) == "image")
    return files.select("path", F.substring("content", 1, 1 << 20).alias("content")).mapInPandas(part, "path string, format string, width int, height int, mode string")


def base64_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("base64"))


def knowledge_graph(spark: SparkSession, path: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a saved graph."""
    return spark.read.format(form).load(f"{path}/graph/vertices"), spark.read.format(form).load(f"{path}/graph/edges")


def knowledge_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of a graph in the interchange form: one JSON document, entities an object by name, relationships a list."""
    entity = "struct<entity_name: string, entity_type: string, description: string>"
    relation = "struct<src_id: string, tgt_id: string, keywords: string, description: string, weight: double>"
    whole = spark.read.schema(f"entities map<string, {entity}>, relationships array<{relation}>").option("multiLine", True).json(path)
    return whole.select(F.explode("entities").alias("key", "e")).select("key", "e.*"), whole.select(F.explode("relationships").alias("r")).select("r.*")
