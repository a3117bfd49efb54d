"""evidence_build against its SQL on texts that are missing, empty or a bare URL, and on pages that quote markup."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import check
from gleaner.functions import text as tx

TEXTS = [None, "", " \n ", "https://a.example.org/x", "of the", "https://a.example.org/x\nof", "营业执照 沪ICP备 网络文化经营许可证"]
PAGES = [
    ("https://b.example.net/en/1", "<title>T&amp;am</title><p>a &amp;lt;b&amp;gt; &amp;copy; c</p>"), ("https://b.example.net/en/2", "<p>&amp;amp;quot;</p>"),
    ("https://github.com/a/b", "<p>code</p>"), ("https://www.xiaohongshu.com/explore/1", ""), ("https://b.example.net/en/3", None), (None, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sent"))
    rows = [(text, kind, page) for text in TEXTS for kind in range(5) for page in [*PAGES, None]]
    docs = [(i, text, "en", f"src{kind}", len(text or "")) for i, (text, kind, _) in enumerate(rows)]
    pages = [(i, *page) for i, (_, _, page) in enumerate(rows) if page]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def test_query(spark, folder):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = entry.queries()["evidence_build"](spark, folder)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()["evidence_build"])
    assert got == check.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_references_are_decoded_once(spark):
    df = spark.createDataFrame([("<p>a &amp;lt;b&amp;gt; &lt;i&gt; &amp;copy;</p>",)], "html string")
    assert df.select(tx.html_to_text(df["html"])).first()[0] == "a &lt;b&gt; <i> &copy;"
