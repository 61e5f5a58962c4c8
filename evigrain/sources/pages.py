"""PDF folders as pages: listing, decoding behind a protocol, vision merge and its error policy.

The decoder runs in the tasks, one file at a time; the vision backend is called in tasks too, so that its
circuit breaker covers one task.  A run-wide breaker would need the driver: run vision pages as a job of
their own for that.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.functions.text import clean_page, trimmed
from evigrain.schemas import MISSING, PAGE
from evigrain.sources.backends import Service, chat

# The header of transcribed text, and the tags of what a page's text comes from.
VISION_HEADER = "[OpenRouter vision/OCR extraction from page image]"
FROM_PDF, FROM_IMAGE, FAILED, SKIPPED, UNKNOWN = "pdf_text", "openrouter_vision", "vision_error", "vision_skipped", "unknown"
MODES, POLICIES = ("off", "auto", "all"), ("warn", "error")


class RawPage(NamedTuple):
    number: int
    label: str
    text: str
    images: int
    total: int
    title: str


class PageDecoder(Protocol):
    def __call__(self, content: bytes) -> Iterator[RawPage]: ...


class PageReader(Protocol):
    """Transcribes a page of a file; raises on failure."""

    def __call__(self, path: str, page: int) -> str: ...


def pymupdf_image(path: str, page: int, dpi: int) -> bytes:
    """A page as PNG; needs PyMuPDF, and a path that the task can open."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("page images need PyMuPDF, or another rasteriser") from e
    with pymupdf.open(re.sub("^file:/*", "/", path), filetype="pdf") as doc:
        return doc[page - 1].get_pixmap(dpi=dpi, alpha=False).tobytes("png")


PROMPT = (
    "Page {page} of {file}, a paper on sepsis. Transcribe what this page shows beyond its running text: tables, figures and their panels, captions, legends, footnotes, flow diagrams. "
    "Keep numbers, units, intervals, p values and labels exactly as printed, mark the result as read from an image, and add nothing that cannot be seen. If there is nothing to transcribe, answer: Not reported"
)


class VisionReader:
    """A reader that shows page images to a service's vision model; `image` makes them."""

    def __init__(self, model: str, service: Service | None, dpi: int = 144, image: Callable[[str, int, int], bytes] = pymupdf_image):
        self.model, self.service, self.dpi, self.image = model, service, dpi, image

    def __call__(self, path: str, page: int) -> str:
        if self.service is None:
            raise RuntimeError("reading page images needs a usable OPENROUTER_API_KEY")
        shown = "data:image/png;base64," + base64.b64encode(self.image(path, page, self.dpi)).decode()
        asked = PROMPT.format(page=page, file=path.rsplit("/", 1)[-1])
        return chat(self.service, self.model, [{"role": "user", "content": [{"type": "text", "text": asked}, {"type": "image_url", "image_url": {"url": shown}}]}])


def pymupdf_pages(content: bytes) -> Iterator[RawPage]:
    """The default decoder; needs PyMuPDF."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("PDF decoding needs PyMuPDF, or another decoder") from e
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        for i, page in enumerate(doc, 1):
            yield RawPage(i, page.get_label() or str(i), page.get_text("text"), len(page.get_images()), doc.page_count, (doc.metadata or {}).get("title") or "")


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, content) of the PDF files directly in a folder, ordered by lower-case name; none if it is missing."""
    if "://" not in folder and not os.path.isdir(folder):
        return spark.createDataFrame([], "path string, file string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content").orderBy(F.lower("file"))


def wants_vision(mode: str, text: Column, images: Column, least_chars: int = 500) -> Column:
    """Whether a page goes to the vision backend."""
    if mode not in MODES:
        raise ValueError(f"vision mode must be one of {', '.join(MODES)}")
    if mode != "auto":
        return F.lit(mode == "all")
    return (F.length(trimmed(F.coalesce(text, F.lit("")))) < least_chars) | (F.coalesce(images, F.lit(0)) > 0)


def with_vision_text(text: Column, vision: Column) -> Column:
    """A page's text with its transcription under a header, unless that is empty or says nothing was found."""
    seen = F.coalesce(F.btrim(vision), F.lit(""))
    base = F.coalesce(text, F.lit(""))
    block = F.concat(F.lit(VISION_HEADER + "\n"), seen)
    return F.when(seen.isin("", MISSING), base).when(base == "", block).otherwise(F.concat(base, F.lit("\n\n"), block))


def out_of_credits(message: str) -> bool:
    return "402" in message and "insufficient credits" in message.lower()


def read_pages(spark: SparkSession, folder: str, decode: PageDecoder = pymupdf_pages, max_pages: int = 0, vision: str = "off", reader: PageReader | None = None, model: str = "", least_chars: int = 500, policy: str = "warn") -> DataFrame:
    """The pages with text of every PDF in a folder; max_pages 0 means all of a file. A decoder's error ends the read."""
    if policy not in POLICIES:
        raise ValueError(f"error policy must be one of {', '.join(POLICIES)}")
    wants_vision(vision, F.lit(""), F.lit(0))  # checks the mode
    if vision != "off" and reader is None:
        raise ValueError("this vision mode needs a page reader")
    raw_schema = "file_name string, file_path string, page_number int, page_label string, total_pages int, title string, embedded_image_count int, raw string"

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, file, content in frame.itertuples(index=False):
                rows = []
                for p in decode(content):
                    if max_pages and p.number > max_pages:
                        break
                    rows.append((file, path, p.number, str(p.number), p.total, p.title or file.rsplit(".", 1)[0], p.images, p.text))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in raw_schema.split(", ")])

    raw = list_pdfs(spark, folder).mapInPandas(pages, raw_schema)
    clean = raw.withColumn("text", clean_page(F.col("raw"))).drop("raw").withColumn("_ask", wants_vision(vision, F.col("text"), F.col("embedded_image_count"), least_chars))
    done = clean.withColumns({"_vision": F.lit(None).cast("string"), "_event": F.lit(None).cast("string")}) if vision == "off" else _transcribed(clean, reader, policy)
    seen = clean_page(F.col("_vision"))
    # A transcription that is blank or says that nothing was found leaves no tag.
    done = done.withColumn("_event", F.when(F.col("_event") != FROM_IMAGE, F.col("_event")).when(~seen.isin("", MISSING), F.col("_event")))
    tags = F.concat_ws(", ", F.when(F.col("text") != "", FROM_PDF), "_event")
    done = done.withColumns({"source_types": F.coalesce(F.nullif(tags, F.lit("")), F.lit(UNKNOWN)), "vision_mode": F.lit(vision), "vision_model": F.when(F.col("_event") == FROM_IMAGE, model).otherwise("")})
    full = done.withColumn("text", with_vision_text(F.col("text"), seen)).where("text <> ''")
    return full.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PAGE.fields)).orderBy("file_name", "page_number")


def _transcribed(pages: DataFrame, reader: Callable[[str, int], str], policy: str) -> DataFrame:
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = False
        for frame in frames:
            texts, events = [], []
            for wanted, path, page in zip(frame["_ask"], frame["file_path"], frame["page_number"]):
                text = event = None
                if wanted and broken:
                    event = SKIPPED
                elif wanted:
                    try:
                        text, event = reader(path, int(page)), FROM_IMAGE
                    except Exception as e:
                        if policy == "error":
                            raise RuntimeError(f"page {page} of {path}: {e}") from e
                        event, broken = FAILED, out_of_credits(str(e))
                texts.append(text)
                events.append(event)
            yield frame.assign(_vision=texts, _event=events)

    return pages.mapInPandas(ask, T.StructType([*pages.schema.fields, T.StructField("_vision", T.StringType()), T.StructField("_event", T.StringType())]))
