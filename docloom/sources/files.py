"""Sources: files, pages, requests, lineage and model configuration.

Files are read with Spark's own binary reader, so any store works and only the listing is on
the driver. Rendering needs codecs that are not part of this library: renderers are plugged
in by format and run on Arrow batches; without one, a page is its text or its bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as fn

PAGE = "array<struct<page_number:int,image:binary>>"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, filename, modified, length, content, mime, format) of the files in a folder or of one file."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return described(reader.load(path))


def stream_files(spark: SparkSession, path: str, glob: str | None = None, per_batch: int = 1000) -> DataFrame:
    """The same as a stream: files that a checkpoint hasn't seen."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return described(reader.schema("path string, modificationTime timestamp, length long, content binary").load(path))


def described(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        "path", name.alias("filename"), F.col("modificationTime").alias("modified"), "length", "content",
        fn.mime_of_name(F.col("path")).alias("mime"), fn.detect_format(F.col("content"), fn.mime_of_name(F.col("path"))).alias("format"),
    )


Renderer = Callable[[bytes, int | None], list[bytes]]


class Adapters:
    """Renderers by format: (content, most pages) -> images, in page order."""

    def __init__(self) -> None:
        self.known: dict[str, Renderer] = {"image": lambda content, most: [content], "html": text_frames}

    def register(self, form: str, renderer: Renderer) -> None:
        self.known[form] = renderer

    def formats(self) -> list[str]:
        return sorted(self.known)

    def pages(self, files: DataFrame, max_pages: int | None = None, keep: list[str] = ("filename",)) -> DataFrame:
        """(keep..., page_number, image, error): a row for each page, 1-based; an image file has number null.

        Other formats give no row. A file that fails gives one row with its error and doesn't
        stop the others. ``max_pages`` 0 gives no pages.
        """
        known, kept = dict(self.known), list(keep)
        source = files.where(F.col("format").isin(*known)).select(*kept, "format", "content")
        fields = [f for f in source.schema.fields if f.name in kept]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                rows = []
                for r in frame.to_dict("records"):
                    own = [r[k] for k in kept]
                    try:
                        images = known[r["format"]](bytes(r["content"]), max_pages)
                        images = images if max_pages is None else images[:max_pages]
                        rows += [(*own, None if r["format"] == "image" else n, x, None) for n, x in enumerate(images, 1)]
                    except Exception as e:  # one bad file is a row, not a failure
                        rows.append((*own, None, None, f"{type(e).__name__}: {e}"))
                out = pd.DataFrame(rows, columns=[*kept, "page_number", "image", "error"])
                out["page_number"] = out["page_number"].astype("Int32")
                yield out

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return source.mapInPandas(run, f"{schema}, page_number int, image binary, error string")


def text_frames(content: bytes, most: int | None, size: int = 3000) -> list[bytes]:
    """The text of HTML in frames of ``size`` characters: what is shown when nothing renders."""
    text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", content.decode("utf-8", "replace"))
    text = " ".join(re.sub(r"<[^>]+>", " ", text).split())
    return [text[k : k + size].encode() for k in range(0, max(1, len(text)), size)]


def page_ranges(pages: Column, size: Column | int) -> Column:
    """(first, last) ranges that cover 1 to ``pages``: explode it to spread a document."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(pages > 0, F.transform(F.sequence(F.lit(1), pages, size), lambda a: F.struct(a.alias("first"), F.least(a + size - 1, pages).alias("last"))))


def requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies (JSON with ``document`` in base64 and ``schema``) as columns with an ``error``.

    A row that can't be read keeps its place with the reason.
    """
    parsed = F.from_json(F.col(body), "document string, schema string, output_format string")
    df = df.withColumn("_r", parsed)
    content = F.try_to_binary(F.col("_r.document"), F.lit("base64"))
    return df.select(
        *[c for c in df.columns if c != "_r"],
        content.alias("content"),
        F.col("_r.schema").alias("schema"),
        F.coalesce("_r.output_format", F.lit("json")).alias("output_format"),
        F.when(F.col(body).isNull() | F.try_parse_json(F.col(body)).isNull(), "Invalid JSON")
        .when(F.col("_r.document").isNull(), "Missing required field: document")
        .when(F.col("_r.schema").isNull(), "Missing required field: schema")
        .when(content.isNull(), "Invalid base64 document")
        .alias("error"),
    )


def lineage(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of exported lineage files."""
    from docloom.operators.lineage import NODE

    return spark.read.schema(NODE).json(path)


def client_config(content: str) -> list[dict]:
    """Clients of a configuration text: name, provider and options."""
    out = []
    for name, body in re.findall(r"client<llm>\s+(\w+)\s*\{(.*?)\n\}", content, re.S):
        provider = re.search(r"provider\s+([\w\"-]+)", body)
        options = dict(re.findall(r"^\s+(model|api_key|base_url|max_tokens|temperature)\s+(.+?)\s*$", body, re.M))
        out.append({"name": name, "provider": provider[1].strip('"') if provider else None, "options": {k: v.strip('"') for k, v in options.items()}})
    return out


def schema_file(text: str) -> dict:
    """A schema given as JSON text or already as a dict."""
    found = json.loads(text) if isinstance(text, str) else text
    if not isinstance(found, dict):
        raise ValueError("a schema is a JSON object")
    return found
