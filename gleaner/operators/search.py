"""Search queries and evidence assembly over a supplied results table or corpus."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators.keyed import distinct_first, top_per_key

TOKEN = r"[A-Za-z0-9][A-Za-z0-9._\-]{1,}|[\x{4e00}-\x{9fff}]{2,10}"
#: Words of a URL that do not help a search.
STOP = ("github", "http", "https", "www", "com", "html")


def query_tokens(c: Column, stop: Iterable[str] = STOP, limit: int | None = None) -> Column:
    """Distinct Latin words and CJK runs, without stop words."""
    stop = tuple(stop)
    found = F.regexp_extract_all(tx.squash(tx.text_or_empty(c)), F.lit(TOKEN), 0)
    kept = F.filter(found, lambda t: ~F.lower(t).isin(*stop))
    return ar.take(F.array_distinct(kept), limit)


def site_query(url: Column, title: Column, summary: Column) -> Column:
    """``site:host`` followed by title and summary tokens."""
    name = F.regexp_replace(urls.host(tx.text_or_empty(url)), r"^www\.", "")
    terms = F.array_distinct(F.concat(ar.take(query_tokens(title), 4), ar.take(query_tokens(summary), 3)))
    return tx.let(
        name,
        lambda n: tx.squash(
            F.concat_ws(" ", F.when(n != "", F.concat(F.lit("site:"), n)), F.array_join(terms, " "))
        ),
    )


def broad_query(title: Column, summary: Column, labels: Column) -> Column:
    label_tokens = ar.take(F.flatten(F.transform(ar.or_empty(labels), lambda x: query_tokens(x))), 2)
    terms = F.concat(ar.take(query_tokens(title), 4), ar.take(query_tokens(summary), 4), label_tokens)
    return tx.squash(F.array_join(F.array_distinct(terms), " "))


def merge_results(results: DataFrame, case_id: str = "case_id", order: Iterable[str] = ("query", "ord"), limit: int = 5) -> DataFrame:
    """Union of several result lists: first hit per URL, then the first ``limit`` per case."""
    order = list(order)
    unique = distinct_first(results, [case_id, "url"], order)
    return top_per_key(unique, [case_id], [F.col(c).asc() for c in order], limit)


def enrich_results(results: DataFrame, pages: DataFrame, case_id: str = "case_id", first: int = 2) -> DataFrame:
    """Attach page text to the first results of every case. Pages have one row per URL.

    Only the first results take part in the join; a hot URL is left to adaptive execution.
    """
    asked = F.coalesce(F.col("rank") <= first, F.lit(False))
    found = results.filter(asked).join(pages.select("url", "page_text"), "url", "left")
    return found.unionByName(results.filter(~asked).withColumn("page_text", F.lit(None).cast("string")))


def evidence_text(results: Column) -> Column:
    """Numbered blocks of title, link and snippet from array<struct<title,url,snippet>>."""
    blocks = F.transform(
        results,
        lambda r, i: F.concat_ws(
            "\n",
            F.concat((i + 1).cast("string"), F.lit(". "), r["title"]),
            r["url"],
            F.nullif(tx.text_or_empty(r["snippet"]), F.lit("")),
        ),
    )
    return F.array_join(blocks, "\n\n")


#: Tokens of queries that the driver and every task hold at once, in bytes.
QUERY_BYTES = 4 << 20


def rank_corpus(
    queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, query_text: str, text: str,
    limit: int = 5, stop: Iterable[str] = STOP, batch_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Top documents per query by number of distinct query tokens they contain; equal numbers by ascending ``doc_id``.

    Queries reach the tasks in batches of bounded size. A document meets them where it is read: a task
    counts the shared tokens per query, drops what is below the worst of its own top list, and hands on
    at most ``limit`` rows per query. So no (query, document) pair of a frequent word moves.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("_query"), query_tokens(F.col(query_text), stop).alias("_tokens")).where(F.size("_tokens") > 0)
    size = asked.agg(F.sum(F.octet_length(F.array_join("_tokens", " ")) + 64)).first()[0] or 0
    n = max(1, -(-int(size) // batch_bytes))
    schema = f"_number long, {doc_id} {corpus.schema[doc_id].dataType.simpleString()}, hits long"
    words = F.array_distinct(F.regexp_extract_all(tx.text_or_empty(F.col(text)), F.lit(TOKEN), 0))
    held = corpus.select(F.col(doc_id), words.alias("_words"))
    parts, numbers, first = [], [], 0
    for k in range(n):
        batch = asked.where(F.pmod(F.xxhash64("_tokens"), F.lit(n)) == k).collect()
        parts.append(held.mapInArrow(_counter([r["_tokens"] for r in batch], first, limit, doc_id), schema))
        numbers += [(first + i, r["_query"]) for i, r in enumerate(batch)]
        first += len(batch)
    hits = reduce(DataFrame.unionByName, parts)
    names = spark.createDataFrame(numbers, f"_number long, {query_id} {queries.schema[query_id].dataType.simpleString()}")
    top = top_per_key(hits, ["_number"], [F.col("hits").desc(), F.col(doc_id).asc()], limit)
    return top.join(names, "_number").select(query_id, doc_id, "hits", "rank")


def _counter(queries: list[list[str]], first: int, limit: int, doc_id: str):
    """A task of :func:`rank_corpus`: the best rows of its documents for each of ``queries``."""
    holders: dict[str, list[int]] = {}
    for q, tokens in enumerate(queries):
        for t in tokens:
            holders.setdefault(t, []).append(q)

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["q", "hits", "id"], ascending=[True, False, True], na_position="first", kind="stable")
        return ordered.groupby("q").head(limit)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        lists = {t: np.array(qs) for t, qs in holders.items()}
        worst, top, kind = np.ones(len(queries), np.int64), None, None
        for batch in batches:
            kind, fresh = batch.schema.field(doc_id).type, []
            for row, words in enumerate(batch.column("_words").to_pylist()):
                shared = [lists[w] for w in words if w in lists]
                if shared:
                    counts = np.bincount(np.concatenate(shared), minlength=len(queries))
                    kept = np.flatnonzero(counts >= worst)
                    fresh.append((np.full(len(kept), row), kept, counts[kept]))
            if not fresh:
                continue
            rows, q, hits = (np.concatenate(x) for x in zip(*fresh))
            ids = batch.column(doc_id).take(pa.array(rows)).to_pandas(types_mapper=pd.ArrowDtype)
            frame = pd.DataFrame({"q": q, "hits": hits, "id": ids.array})
            top = best(frame if top is None else pd.concat([top, frame], ignore_index=True))
            full = top.groupby("q")["hits"].agg(["size", "min"])
            full = full[full["size"] == limit]
            worst[full.index.to_numpy()] = full["min"].to_numpy()
        if top is not None:
            columns = [pa.array(top["q"].to_numpy() + first), pa.array(top["id"], kind), pa.array(top["hits"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, ["_number", doc_id, "hits"])

    return run
