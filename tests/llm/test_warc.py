"""WARC derivatives: text and links of a page, odd rows, and files that read back."""

import datetime
import hashlib

from pyspark.sql import functions as F

from skyloom.llm import warc

PAGE = ('<!DOCTYPE html><html lang="en"><head><title>A &amp;\n B</title><style>p{}</style></head><body><!-- no --><h1>Head</h1>'
        '<p>One <b>two</b>&nbsp;&lt;3<br>four<script>var t="</p>";</script><a href="/x">x</a> <A class=k href="/y">y</A></p></body></html>')


def pages(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(1, "http://a/é", PAGE), (2, None, None), (3, "u", ""), (None, "v", "<p>plain"), (1, "http://a/é", PAGE)]
    return spark.createDataFrame([(*r, day, day) for r in rows], "page_id long, url string, html string, block date, payload date")


def test_records(spark):
    rows = warc.build(pages(spark)).collect()
    assert len(rows) == 15
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    response, metadata, text = (by[1, t] for t in ("response", "metadata", "conversion"))
    assert text["block"] == "Head\nOne two <3\nfourx y"
    assert text["refers_to"] == metadata["refers_to"] == response["record_id"] and response["refers_to"] is None
    fields = dict(line.split(": ", 1) for line in metadata["block"].strip().split("\r\n"))
    assert (fields["title"], fields["language"], fields["outlinks"]) == ("A & B", "en", "2")
    assert fields["source-block-digest"] == response["block_digest"] == "sha256:" + hashlib.sha256(response["block"].encode()).hexdigest()
    assert len({r["record_id"] for r in rows}) == 12  # the repeated page makes the same records again
    assert by[2, "conversion"]["block"] == "" and by[2, "response"]["target_uri"] is None
    assert warc.build(pages(spark).limit(0)).collect() == []


def test_links_in_all_forms_of_attribute_values(spark):
    html = """<a href="/a">a</a> <a class=k href='/b'>b</a> <A HREF=/c>c</A> <a href = "/d" id=x>d</a> <a href=''>e</a> <a id="f">f</a>"""
    rows = warc.build(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    assert "outlinks: 5\r\n" in rows.filter("record_type = 'metadata'").first()["block"]


def test_files_read_back(spark, tmp_path):
    records = warc.build(pages(spark)).filter("page_id IS NOT NULL").dropDuplicates(["record_id"])
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).select(
        F.col("headers")["warc-record-id"], F.col("headers")["warc-refers-to"], F.col("headers")["warc-block-digest"], "block")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(
        str((r["record_id"], r["refers_to"], r["block_digest"], r["block"])) for r in records.collect())


def test_hostile_pages_take_linear_time(spark):
    import time

    start = time.time()
    for opener in ("<!-- ", "<script> ", "<title> ", "<a ", "<p ", "<html ", "<", "<a href='"):
        html = "<p>seen</p>" + opener * (2_000_000 // len(opener))
        rows = warc.build(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
        assert len(rows) == 3 and next(r for r in rows if r["record_type"] == "conversion")["block"].startswith("seen")
    assert time.time() - start < 60
