"""Files to pages: a registry of formats over Spark's binary file source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Suffixes by reader. PDF text and image captions need a model or library that is passed in.
FORMATS = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".docx": "docx", ".pdf": "pdf"}
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif")
SCANNED_BELOW, SCANNED_PAGES = 20, 3
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def supported(images: bool = False) -> list[str]:
    return [*FORMATS, *(IMAGES if images else ())]


def scan(spark: SparkSession, folder: str, recursive: bool = True, suffixes: list[str] | None = None) -> DataFrame:
    """Files of a folder with one of the suffixes (all supported ones by default), without excluded folders.

    Spark itself never lists names that start with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    path = F.col("path")
    return reader.load(folder).withColumn("suffix", T.suffix(path)).where(F.col("suffix").isin(*(suffixes or supported())) & ~T.excluded(path))


@dataclass(frozen=True)
class Watch:
    """A folder to read, with its own suffixes (all supported ones by default)."""

    folder: str
    recursive: bool = True
    suffixes: tuple[str, ...] | None = None


def scan_all(spark: SparkSession, watches: list[Watch]) -> DataFrame:
    """Files of several folders; a file that several of them reach is there once."""
    if not watches:
        raise ValueError("there has to be a folder to read")
    each = [scan(spark, w.folder, w.recursive, list(w.suffixes) if w.suffixes else None) for w in watches]
    if len(each) == 1:
        return each[0]
    # Paths are made distinct without the files' content.
    named = [df.withColumn("watch", F.lit(i)) for i, df in enumerate(each)]
    every = reduce(DataFrame.unionByName, named)
    first = every.groupBy("path").agg(F.min("watch").alias("watch"))
    return every.join(first, ["path", "watch"]).drop("watch")


def docx_text(content: bytes) -> str:
    """Paragraphs with text, then tables: a row's filled cells joined by bars."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = [s for p in body.findall(f"{_W}p") if (s := said(p))]
    for row in body.iter(f"{_W}tr"):
        if cells := [s for c in row.findall(f"{_W}tc") if (s := said(c))]:
            out.append(" | ".join(cells))
    return "\n".join(out)


def pages(files: DataFrame, extractors: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """``(path, page_num, text, tags, status, error_msg)`` of scanned files.

    Text and markdown are read by the JVM, invalid bytes replaced; DOCX, and what ``extractors`` (suffix
    to a function from bytes to page texts) take, in Arrow batches. Other files get one row, status ``unsupported``;
    a file that its reader cannot read gets one with status ``error`` and what the reader said.
    """
    own = {".docx": lambda b: [docx_text(b)]} | (extractors or {})
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    none = F.array().cast("array<string>")
    is_md = F.col("suffix").isin(".md", ".markdown")
    plain = files.where(F.col("suffix").isin(".txt", ".md", ".markdown")).select(
        "path", F.lit(1).alias("page_num"), F.when(is_md, T.clean_markdown(T.body(raw))).otherwise(raw).alias("text"), F.when(is_md, T.merged_tags(raw)).otherwise(none).alias("tags"), F.lit("ok").alias("status"), F.lit("").alias("error_msg")
    )

    def run(batches):
        for batch in batches:
            rows = []
            for path, suffix, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [(path, i, text, "ok", "") for i, text in enumerate(own[suffix](content), 1)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((path, 1, "", "error", f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "page_num", "text", "status", "error_msg"])

    rest = files.where(~F.col("suffix").isin(".txt", ".md", ".markdown"))
    read = rest.where(F.col("suffix").isin(*own)).select("path", "suffix", "content").mapInArrow(run, "path string, page_num int, text string, status string, error_msg string")
    read = read.select("path", "page_num", "text", none.alias("tags"), "status", "error_msg")
    unknown = rest.where(~F.col("suffix").isin(*own)).select("path", F.lit(1).alias("page_num"), F.lit("").alias("text"), none.alias("tags"), F.lit("unsupported").alias("status"), F.lit("no reader for this kind of file").alias("error_msg"))
    return plain.unionByName(read).unionByName(unknown)


def is_scanned(pages: DataFrame) -> DataFrame:
    """``(path, is_scanned)``: under 20 visible characters on the first three pages."""
    seen = F.sum(F.when(F.col("page_num") <= SCANNED_PAGES, F.length(F.regexp_replace("text", r"(?U)\s", ""))).otherwise(0))
    return pages.groupBy("path").agg((seen < SCANNED_BELOW).alias("is_scanned"))


#: A span this much larger than the body makes its line a heading.
HEADING_SCALE = 1.2


def font_headings(spans: DataFrame) -> DataFrame:
    """``spans(page_id, line_no, span_no, text, size, bold)`` of pages to ``(page_id, headings)``: lines with a span
    that is bold or much larger than the page's upper median size, each once, in order.

    Pages without a heading have an empty list, blank lines are none; a page's spans are gathered, not those of others.
    """
    span = F.struct("span_no", "text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["text"]), "")
    body = spans.groupBy("page_id").agg(F.sort_array(F.collect_list(F.col("size").cast("double"))).alias("sizes"))
    body = body.select("page_id", F.get("sizes", F.expr("cast(size(sizes) div 2 as int)")).alias("body"))
    largest, any_bold = F.max(F.col("size").cast("double")).alias("size"), F.max(F.coalesce("bold", F.lit(False))).alias("bold")
    lines = spans.groupBy("page_id", "line_no").agg(T.strip(said).alias("line"), largest, any_bold).join(body, "page_id")
    heads = F.when((F.col("line") != "") & (F.col("bold") | (F.col("size") >= HEADING_SCALE * F.col("body"))), F.struct("line_no", "line"))
    found = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(heads)).alias("found"))
    return found.select("page_id", F.array_distinct(F.transform("found", lambda x: x["line"])).alias("headings"))
