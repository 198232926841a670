"""A Spark data source for landing folders of documents and of links, as a batch and as a stream.

    spark.dataSource.register(LandingSource)
    spark.read.format("landing").option("kind", "links").load("hdfs:///drop/links")
    spark.readStream.format("landing").option("kind", "files").load("hdfs:///drop/uploads")

``files`` gives a row per PDF or Markdown file. ``links`` reads files of JSON lines with url and, if
wanted, title, source_type and entity_id, and fetches each address inside the tasks. What cannot be
read, parsed or fetched is a row with ``error`` and no content. A stream's offset is the time and name
of the newest file taken, so files must land with the time at which they become complete.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from engram.functions.text import GOOGLE_DOC_PATTERN
from engram.sources.files import EXPORT_URL, fetch

SCHEMA = ("document_id string, title string, source_type string, source_url string, file_path string, "
          "entity_id string, created_at timestamp, content binary, error string")
#: Kinds of uploads by extension, and kinds that a link may declare.
EXTENSIONS = {".pdf": "pdf", ".md": "markdown", ".markdown": "markdown"}
LINK_KINDS = ("web_page", "google_docs", "pdf")


def link_kind(url: str, declared: str | None = None) -> str:
    """The declared kind if it is one, else read off the address."""
    if declared in LINK_KINDS:
        return declared
    if "docs.google.com" in url:
        return "google_docs"
    return "pdf" if url.lower().split("?", 1)[0].endswith(".pdf") else "web_page"


def export_address(url: str, kind: str) -> str:
    found = re.search(GOOGLE_DOC_PATTERN, url) if kind == "google_docs" else None
    return EXPORT_URL % found[1] if found else url


@dataclass
class Files(InputPartition):
    """Some files of the folder: name and time in nanoseconds."""

    files: list[tuple[str, int]]


class _Landing:
    def __init__(self, options: dict[str, str]) -> None:
        options = {name.lower(): value for name, value in options.items()}
        self.kind = options.get("kind", "files")
        if self.kind not in ("files", "links"):
            raise ValueError("kind is files or links")
        self.path = options["path"]
        self.token = options.get("token")
        self.max_bytes = int(options["maxbytes"]) if "maxbytes" in options else None
        self.per_partition = int(options.get("filesperpartition", 16))

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        if re.match(r"\w+:/", self.path):
            return arrow_fs.FileSystem.from_uri(self.path)
        return arrow_fs.LocalFileSystem(), self.path

    def listed(self) -> list[tuple[str, int]]:
        """Files below the folder by time and name; hidden ones are left out."""
        system, root = self._open()
        found = system.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
        wanted = [
            (f.path, f.mtime_ns or 0) for f in found
            if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "_"))
            and (self.kind == "links" or posixpath.splitext(f.base_name)[1].lower() in EXTENSIONS)
        ]
        return sorted(wanted, key=lambda f: (f[1], f[0]))

    def dealt(self, files: list[tuple[str, int]]) -> list[Files]:
        step = self.per_partition
        return [Files(files[i : i + step]) for i in range(0, len(files), step)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._open()
        for path, time in partition.files:
            at = datetime.datetime.fromtimestamp(time / 1e9, datetime.timezone.utc)
            try:
                size = system.get_file_info(path).size
                too_large = self.kind == "files" and self.max_bytes is not None and size > self.max_bytes
                content = None if too_large else system.open_input_stream(path).read()
                error = f"larger than {self.max_bytes} bytes" if too_large else None
            except OSError as failure:
                content, error = None, str(failure)
            if self.kind == "files":
                name = posixpath.basename(path)
                kind = EXTENSIONS[posixpath.splitext(name)[1].lower()]
                yield self._row(f"{path}#{time}", name, kind, "", path, "", at, content, error)
            elif content is None:
                yield self._row(f"{path}#{time}", posixpath.basename(path), None, "", path, "", at, None, error)
            else:
                yield from self._links(path, time, at, content)

    def _links(self, path: str, time: int, at: datetime.datetime, content: bytes) -> Iterator[tuple]:
        for number, line in enumerate(content.decode("utf-8", "replace").splitlines()):
            if not line.strip():
                continue
            key = f"{path}#{time}#{number}"
            try:
                link = json.loads(line)
                url = link["url"]
                if not isinstance(url, str) or not url:
                    raise KeyError("url")
            except (ValueError, KeyError, TypeError):
                yield self._row(key, "", None, "", path, "", at, None, f"line {number + 1}: URL is required")
                continue
            kind = link_kind(url, link.get("source_type"))
            found, error = fetch(export_address(url, kind), kind, self.token, self.max_bytes)
            yield self._row(key, link.get("title") or url, kind, url, "", link.get("entity_id") or "", at, found, error)

    @staticmethod
    def _row(key: str, title, kind, url, path, entity, at, content, error) -> tuple:
        return str(uuid.uuid3(uuid.NAMESPACE_DNS, key)), str(title), kind, url, path, str(entity), at, content, error


class _Batch(_Landing, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed())


class _Stream(_Landing, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"time": files[-1][1], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = ((o["time"], o["path"]) for o in (start, end))
        return self.dealt([f for f in self.listed() if first < (f[1], f[0]) <= last])

    def commit(self, end: dict) -> None:
        pass


class LandingSource(DataSource):
    """Options: path, kind (files or links), maxBytes, token, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
