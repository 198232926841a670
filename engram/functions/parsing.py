"""Parsers of document sources as Arrow-batched columns."""

from __future__ import annotations

import io
import shutil
import subprocess

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.chunking import SPACE
from engram.functions.html import page_content

PARSED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def _shown(value: object) -> str:
    """A front-matter value as plain text."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + " ".join(_shown(v) for v in value) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{_shown(v)}" for k, v in sorted(value.items())) + "]"
    return str(value)


def markdown_content(text: str) -> tuple[str, dict[str, str]]:
    """Body and front matter of a Markdown text; unclosed front matter is body."""
    metadata: dict[str, str] = {}
    if text.startswith(("---\n", "---\r\n")):
        lines = [line.removesuffix("\r") for line in text.split("\n")[1:]]
        if "---" in lines:
            end = lines.index("---")
            metadata = _front_matter("\n".join(lines[:end]))
            text = "\n".join(lines[end + 1:])
    return text.strip(SPACE), metadata


def _front_matter(block: str) -> dict[str, str]:
    try:
        import yaml
    except ImportError:  # plain "key: value" lines only
        pairs = (line.split(":", 1) for line in block.splitlines() if ":" in line)
        return {k.strip(): v.strip().strip("'\"") for k, v in pairs}
    try:
        loaded = yaml.load(block, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return {}
    return {str(k): _shown(v) for k, v in loaded.items()} if isinstance(loaded, dict) else {}


def pdf_content(data: bytes) -> tuple[str, dict[str, str]]:
    """Text of a PDF through ``pdftotext`` or ``pypdf``, whichever is installed."""
    tool = shutil.which("pdftotext")
    if tool:
        run = subprocess.run([tool, "-", "-"], input=data, capture_output=True, timeout=300)
        if run.returncode == 0:
            text = run.stdout.decode(errors="ignore")
            pages = text.count("\f") or (1 if text else 0)
            return text, {"page_count": str(pages), "parser": "pdftotext"}
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("no PDF reader is installed") from error
    reader = PdfReader(io.BytesIO(data))
    text = "".join((page.extract_text() or "") + "\n" for page in reader.pages)
    return text, {"page_count": str(len(reader.pages)), "parser": "native"}


def parse_bytes(kind: str, data: bytes) -> tuple[str | None, dict[str, str], str | None]:
    """Parse one source; invalid UTF-8 is dropped, an error is returned as text."""
    try:
        if kind == "pdf":
            text, metadata = pdf_content(data)
        else:
            plain = data.decode(errors="ignore")
            if kind == "markdown":
                text, metadata = markdown_content(plain)
            elif kind == "web_page":
                text, metadata = page_content(plain)
            elif kind == "google_docs":
                text, metadata = plain.strip(SPACE), {}
            else:
                raise ValueError(f"unsupported source type {kind}")
    except Exception as error:  # a bad document fails alone
        return None, {}, f"{type(error).__name__}: {error}"
    return text, metadata, None


@F.pandas_udf(PARSED)
def _parse(kind: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = [parse_bytes(k, bytes(d)) for k, d in zip(kind, data)]
    return pd.DataFrame(rows, columns=["text", "metadata", "error"])


def parse_column(kind: Column, data: Column) -> Column:
    """text, metadata and error of a document given its kind and its bytes."""
    return _parse(kind, F.coalesce(data, F.lit(b"")))
