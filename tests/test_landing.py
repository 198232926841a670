"""The landing source over folders and file: addresses; links taken in by one plan."""

import os

import pytest
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.models.provider import OfflineProvider
from engram.plans.ingest import ingest_links
from engram.sources import landing
from engram.sources.store import MemoryStore


@pytest.fixture
def drop(spark, tmp_path):
    spark.dataSource.register(landing.LandingSource)
    folder = tmp_path / "drop"
    (folder / "sub").mkdir(parents=True)
    return folder


def put(path, content, at):
    path.write_bytes(content)
    os.utime(path, ns=(at * 10**9, at * 10**9))


def test_files_are_rows(spark, drop):
    put(drop / "a.md", b"# Title\n\ntext", 100)
    put(drop / "sub" / "B.MARKDOWN", b"", 101)
    put(drop / "big.pdf", b"x" * 50, 102)
    for name in ("skip.txt", "_hidden.md", ".dot.md"):
        put(drop / name, b"no", 103)
    read = spark.read.format("landing").option("maxBytes", "20").option("filesPerPartition", "1").load(str(drop))
    rows = {r.title: r for r in read.collect()}
    assert set(rows) == {"a.md", "B.MARKDOWN", "big.pdf"} and read.rdd.getNumPartitions() == 3
    assert bytes(rows["a.md"].content) == b"# Title\n\ntext" and rows["a.md"].source_type == "markdown" and rows["a.md"].error is None
    assert rows["big.pdf"].content is None and rows["big.pdf"].error == "larger than 20 bytes"
    assert len({r.document_id for r in rows.values()}) == 3
    assert spark.read.format("landing").load(str(drop / "none")).count() == 0
    with pytest.raises(Exception, match="kind is files or links"):
        spark.read.format("landing").option("kind", "x").load(str(drop)).count()


def links_file(drop, at=100, name="l1.json"):
    page = drop.parent / "page.html"
    page.write_bytes(b"<html><head><title>T</title></head><body><p>Some words of a page.</p></body></html>")
    lines = [
        f'{{"url": "{page.as_uri()}", "title": "A page", "entity_id": "e"}}', "", "not json", "[1]", '{"title": "no address"}', '{"url": 5}',
        f'{{"url": "{(drop.parent / "gone.pdf").as_uri()}"}}', '{"url": "nowhere", "source_type": "pdf"}',
    ]
    put(drop / name, "\n".join(lines).encode(), at)
    return page


def test_links_are_fetched_and_failures_are_rows(spark, drop):
    links_file(drop)
    rows = spark.read.format("landing").option("kind", "links").load(drop.as_uri()).collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) == 7 and [(r.title, r.source_type, r.entity_id) for r in good] == [("A page", "web_page", "e")]
    assert b"Some words" in good[0].content
    errors = [r.error for r in rows if r.error]
    assert sum("URL is required" in e for e in errors) == 4
    gone = next(r for r in rows if r.source_url.endswith("gone.pdf"))
    assert gone.source_type == "pdf" and gone.title == gone.source_url and "No such file" in gone.error
    assert "unknown url type" in next(r.error for r in rows if r.source_url == "nowhere")


def test_stream_takes_each_file_once(spark, drop, tmp_path):
    def run():
        stream = spark.readStream.format("landing").option("kind", "links").load(str(drop))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    links_file(drop)
    assert run() == 7 and run() == 7
    links_file(drop, 200, "l2.json")
    assert run() == 14


def test_kinds_and_addresses_agree_with_the_columns(spark):
    urls = ["https://docs.google.com/document/d/a-B_1/edit?x=1", "http://x/a.PDF?y=z.html", "http://x/a.html", "docs.google.com/none", "http://x/?a.pdf"]
    for declared in (None, "pdf", "markdown"):
        frame = spark.createDataFrame([(u, declared) for u in urls], "u string, d string")
        kinds = [r.k for r in frame.select(X.source_type(F.col("u"), F.col("d")).alias("k")).collect()]
        assert kinds == [landing.link_kind(u, declared) for u in urls]
    assert landing.export_address(urls[0], "google_docs").endswith("id=a-B_1&exportFormat=txt")
    assert landing.export_address(urls[3], "google_docs") == urls[3]


def test_ingest_links(spark, drop, tmp_path):
    page = links_file(drop)
    store = MemoryStore(spark, f"{tmp_path}/store")
    store.create()
    links = spark.createDataFrame([(page.as_uri(), None), (page.as_uri(), "again"), ("", "blank"), (None, None), ((tmp_path / "no.html").as_uri(), "")], "url string, title string")
    accepted, refused = ingest_links(store, links, OfflineProvider(), F.lit("2024-05-01").cast("timestamp"), batch="b")
    assert sorted(r.reason for r in refused.collect()) == ["URL is required"] * 2
    names = {r.url: (r.document_id, r.title) for r in accepted.collect()}
    assert set(names) == {page.as_uri(), (tmp_path / "no.html").as_uri()} and names[(tmp_path / "no.html").as_uri()][1].endswith("no.html")
    status = {r.id: (r.status, r.error_message) for r in store.documents().collect()}
    assert status[names[page.as_uri()][0]] == ("completed", "")
    failed = status[names[(tmp_path / "no.html").as_uri()][0]]
    assert failed[0] == "failed" and "No such file" in failed[1]
    assert store.read("chunks").count() == 1
