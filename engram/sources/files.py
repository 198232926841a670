"""Document sources: uploaded files, links and landing folders."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.text import file_type, google_doc_id, source_type, uuid3

EXPORT_URL = "https://docs.google.com/feeds/download/documents/export/Export?id=%s&exportFormat=txt"


def as_sources(files: DataFrame, entity_id: Column | None = None) -> DataFrame:
    """Sources out of ``binaryFile`` rows; other extensions are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("source_type", file_type(name)).filter(F.col("source_type").isNotNull()).select(
        uuid3(F.concat_ws("#", "path", F.col("modificationTime").cast("string"))).alias("document_id"),
        name.alias("title"), "source_type", F.lit("").alias("source_url"), F.col("path").alias("file_path"),
        (F.lit("") if entity_id is None else entity_id).alias("entity_id"),
        F.col("modificationTime").alias("created_at"), "content",
    )


def read_files(spark: SparkSession, path: str, entity_id: Column | None = None) -> DataFrame:
    """PDF and Markdown files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return as_sources(files, entity_id)


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same folder as a stream; the number of files per batch is the back-pressure."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return as_sources(files)


def link_sources(links: DataFrame, now: Column, content: Column | None = None) -> DataFrame:
    """Sources out of links (url, title, declared, entity_id), content given or fetched later."""
    kind = source_type(F.col("url"), F.col("declared"))
    fetch = F.when(
        kind == "google_docs", F.format_string(EXPORT_URL, google_doc_id(F.col("url")))
    ).otherwise(F.col("url"))
    return links.select(
        uuid3(F.concat_ws("#", "url", now.cast("string"))).alias("document_id"), "title",
        kind.alias("source_type"), F.col("url").alias("source_url"), F.lit("").alias("file_path"),
        "entity_id", now.alias("created_at"), fetch.alias("fetch_url"),
        (F.lit(None).cast("binary") if content is None else content).alias("content"),
    )


# Seconds that a fetch of each kind may take.
TIMEOUTS = {"web_page": 10, "pdf": 30, "google_docs": 15}


def fetch(url: str, kind: str, token: str | None = None, max_bytes: int | None = None) -> tuple[bytes | None, str | None]:
    """The bytes behind an address, or why there are none.

    A shared document must answer with status 200; a page of another status is taken as it is.
    """
    headers = {"User-Agent": "Mozilla/5.0 (compatible; engram)"}
    if kind == "google_docs" and token:
        headers["Authorization"] = f"Bearer {token}"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUTS.get(kind, 10)) as answer:
            content = answer.read() if max_bytes is None else answer.read(max_bytes + 1)
    except urllib.error.HTTPError as error:
        if kind != "web_page":
            return None, f"status {error.code}"
        content = error.read()
    except (OSError, ValueError) as error:  # no such host or file, time-out, no address at all
        return None, str(getattr(error, "reason", error)) or type(error).__name__
    if max_bytes is not None and len(content) > max_bytes:
        return None, f"larger than {max_bytes} bytes"
    return content, None


def fetch_links(sources: DataFrame, token: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Download the content of link sources inside the tasks; ``error`` says why content is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [
                (c, None) if c is not None else fetch(u, k, token, max_bytes)
                for c, u, k in zip(rows["content"], rows["fetch_url"], rows["source_type"])
            ]
            rows["content"], rows["error"] = [f[0] for f in found], [f[1] for f in found]
            yield rows

    return sources.mapInPandas(run, T.StructType([*sources.schema.fields, T.StructField("error", T.StringType())]))
