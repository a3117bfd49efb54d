"""Evidence build for the non-media branches, and the summary cache."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.config import CacheConfig
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import compaction as cp
from gleaner.operators import predicates as pr
from gleaner.operators import pages, profiles, signals
from gleaner.operators.keyed import distinct_last, salted_lookup, top_per_key

#: Notices shown instead of a blocked page.
NOTICES = {
    "page_gone": (
        "这条小红书图文当前在本地环境下已经返回“页面不可见/暂时无法浏览”，所以拿不到正文内容。"
        "更像是原链接失效或平台当前对这条笔记做了访问限制，这次只能确认链接本身存在，暂时不能把正文当成已成功抓取。"
    ),
    "access_restricted": (
        "这条小红书图文当前触发了平台安全限制，页面没有返回可用正文。问题更像是平台风控或当前网络环境受限，而不是这条内容本身不存在；"
        "如果要继续验证，优先考虑切换网络、浏览器环境或登录态后重试。"
    ),
}
EVIDENCE_TYPES = {"text": "raw_text", "web": "visible_page_text", "repository": "structured_github_text", "image": "ocr"}


def user_text(raw: Column, url: Column) -> Column:
    """Text the user sent, unless it only repeats the URL."""
    v = tx.strip(tx.text_or_empty(raw))
    return F.when(pr.is_url_only(v, url), F.lit("")).otherwise(v)


def build_evidence(
    requests: DataFrame, lexicon: signals.SignalLexicon = signals.DEFAULT, as_sent: bool = False,
    footers: Iterable[str] = lx.LEGAL_FOOTER_TOKENS, code_hosts: Iterable[str] = ("github.com",),
) -> DataFrame:
    """Evidence rows for text, web, repository and image requests.

    Expects requests already joined with their tracks: ``source_kind, source_url,
    raw_text, platform_hint, page_title, page_text, repo_lines`` (array),
    ``ocr_lines`` (array) and ``fetch_warnings`` (array). All branches are column
    expressions over one row, so the whole build needs no exchange.

    ``as_sent``: what the user sent counts as it is, a bare URL too, and is named as a source even
    if it is empty. ``footers`` and ``code_hosts``: vocabularies of the legal footer and the repository branch.
    """
    kind, url = F.col("source_kind"), F.col("source_url")
    raw = tx.strip(tx.text_or_empty(F.col("raw_text")))
    df = requests.withColumns(
        {
            "branch": pr.route(kind, url, F.col("platform_hint"), code_hosts),
            "_raw": raw,
            "_user": raw if as_sent else user_text(F.col("raw_text"), url),
            "_ocr": F.array_join(cp.salient_lines(F.col("ocr_lines"), 16), "\n"),
            "_repo": F.array_join(ar.or_empty(F.col("repo_lines")), "\n"),
            "_page": tx.strip(tx.text_or_empty(F.col("page_text"))),
            "_warn": ar.keep_first(F.col("fetch_warnings")),
        }
    )
    ocr_block = F.when(F.col("_ocr") != "", F.concat(F.lit("[OCR补充]\n"), F.col("_ocr")))
    web = ar.merge_blocks(F.col("_user"), F.col("_page"), ocr_block)
    failed = F.concat(F.lit("[fetch error] "), F.array_join(ar.take(F.col("_warn"), 2), " | "))
    df = df.withColumn("_web", web)
    web_text = F.when((F.col("_web") == "") & (F.size("_warn") > 0), failed).otherwise(F.col("_web"))
    code = pr.blocked_notice(url, F.col("page_title"), F.col("_warn"))
    notice = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in NOTICES.items()], F.lit(""))
    df = df.withColumns({"_webtext": web_text, "_notice": notice})
    # A legal footer is no content: it makes way for a notice or for nothing.
    readable = F.when(pr.is_legal_footer(F.col("_webtext"), footers), F.lit("")).otherwise(F.col("_webtext"))
    df = df.withColumn("_readable", readable)
    blocked = (F.col("branch") == "web") & (F.col("_readable") == "") & (F.col("_notice") != "")
    by_branch = {
        "text": F.col("_raw"),
        "repository": ar.merge_blocks(F.coalesce(F.nullif("_repo", F.lit("")), F.col("_page")), F.col("_user")),
        "image": ar.merge_blocks(F.col("_ocr"), F.col("_raw")),
        "web": F.when(blocked, F.col("_notice")).otherwise(F.col("_readable")),
    }
    df = df.filter(F.col("branch") != "video")
    text = F.coalesce(*[F.when(F.col("branch") == b, t) for b, t in by_branch.items()])
    kind_of_text = F.coalesce(*[F.when(F.col("branch") == b, F.lit(t)) for b, t in EVIDENCE_TYPES.items()])
    sent = F.lit(as_sent) | (F.when(F.col("branch").isin("text", "image"), F.col("_raw")).otherwise(F.col("_user")) != "")
    sources = F.array_compact(
        F.array(
            F.when((F.col("branch") == "image") & (F.col("_ocr") != ""), F.lit("uploaded_image_ocr")),
            F.when(sent, F.lit("user_raw_text")),
            F.when((F.col("branch") == "repository") & (F.col("_repo") != ""), F.lit("repository_document")),
            F.when(F.col("branch").isin("web", "repository") & (F.col("_page") != ""), F.lit("web_html_document")),
            F.when((F.col("branch") == "web") & (F.col("_ocr") != ""), F.lit("browser_screenshot_ocr")),
            F.when(blocked, F.lit(lx.BLOCKED_SOURCE)),
        )
    )
    df = df.withColumns({"text": text, "evidence_type": kind_of_text, "evidence_sources": sources, "title": F.col("page_title")})
    whole = F.array_contains("evidence_sources", lx.BLOCKED_SOURCE) | (F.col("text") == "")
    df = df.withColumn("coverage", F.when(whole, F.lit("partial")).otherwise(F.lit("full")))
    df = signals.extract_signals(df, lexicon=lexicon)
    tight = signals.tighten_signals(F.col("signals"), url)
    df = df.withColumn("signals", F.when(F.col("branch") == "repository", tight).otherwise(F.col("signals")))
    df = profiles.finalize_evidence(df)
    return df.withColumn("fetch_warnings", F.col("_warn")).drop(*[c for c in df.columns if c.startswith("_")])


def repo_lines(name: Column, url: Column, description: Column, readme: Column) -> Column:
    """Line layout of a repository page: name, address, description and key lines."""
    keys = ar.take(cp.doc_key_lines(readme), 14)
    head = F.array_compact(
        F.array(
            F.concat(F.lit("项目仓库: "), name),
            F.concat(F.lit("仓库地址: "), url),
            F.when(tx.text_or_empty(description) != "", F.concat(F.lit("仓库简介: "), description)),
        )
    )
    return F.when(F.size(keys) > 0, F.concat(head, ar.strings("[README关键信息]"), keys)).otherwise(head)


def merge_sources(*tables: DataFrame, key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Union of (doc, pos, source) tables to one distinct, ordered source list per doc.

    Names are reduced to their first position, and to the first ``limit`` names per
    doc if there is a limit, before they are collected.
    """
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    first = union.filter(F.trim("source") != "").groupBy(key, "source").agg(F.min("pos").alias("pos"))
    if limit is not None:
        first = top_per_key(first, [key], [F.col("pos").asc(), F.col("source").asc()], limit)
    packed = F.sort_array(F.collect_list(F.struct("pos", "source")))
    return first.groupBy(key).agg(F.transform(packed, lambda e: e["source"]).alias("evidence_sources"))


def fingerprint(version: str = "1") -> Column:
    """SHA-256 over what a summary depends on. Whole texts count, not prefixes.

    Reads ``source_url, evidence_type, coverage, text, transcript, tracks``.
    """
    payload = F.struct(
        urls.canonical_url(F.col("source_url")).alias("source_url"),
        F.col("evidence_type"),
        F.col("coverage"),
        tx.squash(tx.text_or_empty(F.col("text"))).alias("text"),
        tx.squash(tx.text_or_empty(F.col("transcript"))).alias("transcript"),
        F.col("tracks"),
        F.lit(version).alias("version"),
    )
    return F.sha2(F.to_json(payload), 256)


def cache_lookup(items: DataFrame, cache: DataFrame, now: Column, cfg: CacheConfig = CacheConfig(), key: str = "source_url") -> DataFrame:
    """Add ``cached`` and ``cached_summary``: same URL, same fingerprint, not older than the TTL.

    The cache has one row per URL. An entry exactly at the TTL is still valid.
    """
    ttl = max(1, cfg.ttl_hours)
    entries = cache.select(
        F.col(key).alias("_key"), F.col("created_at").alias("_at"), F.col("fingerprint").alias("_fp"), F.col("summary").alias("_summary")
    )
    keyed = items.withColumn("_key", urls.canonical_url(F.col(key)))
    joined = salted_lookup(keyed, entries, ["_key"], "left")
    age_ok = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp")) <= F.lit(ttl * 3600 * 1_000_000)
    hit = F.coalesce((F.col("_key") != "") & (F.col("_fp") == F.col("fingerprint")) & age_ok, F.lit(False))
    return joined.withColumns({"cached": hit, "cached_summary": F.when(hit, F.col("_summary"))}).drop("_key", "_at", "_fp", "_summary")


def cache_update(cache: DataFrame, entries: DataFrame, key: str = "source_url") -> DataFrame:
    """Cache after new entries; the last write per URL stays."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    both = both.filter(F.col(key) != "").withColumn("_at", F.col("created_at"))
    return distinct_last(both, [key], ["_at", "_new"]).drop("_new", "_at")


def match_pages(requests: DataFrame, pages: DataFrame, request_id: str, page_url: str = "page_url") -> DataFrame:
    """Captured page of a request URL: exact, then normalised, then by host and path.

    Each request and page offers three tagged keys, so one equi-join covers the
    three passes; the best pass per request is a minimum, not a sort.
    """

    def keys(url: Column) -> Column:
        options = (tx.strip(url), urls.match_url(url), urls.path_key(url))
        return F.array(*[F.struct(F.lit(i).alias("prio"), v.alias("key")) for i, v in enumerate(options)])

    r = ar.explode_rows(requests, request_id, keys(F.col("source_url")), "k").select(request_id, "k.*")
    p = ar.explode_rows(pages, page_url, keys(F.col(page_url)), "k").select("k.*", page_url)
    p = p.groupBy("prio", "key").agg(F.min(page_url).alias(page_url))
    hits = salted_lookup(r, p, ["prio", "key"], "inner", deal_by=[request_id])
    return hits.groupBy(request_id).agg(F.min_by(page_url, "prio").alias(page_url), F.min("prio").alias("match_pass"))


def document_evidence(
    df: DataFrame, doc: str = "document", source: str = "source_url", warnings: str = "warnings", extra: str | None = None, **options,
) -> DataFrame:
    """Evidence of structured documents: adds text, signals, evidence_type, coverage and fetch_warnings.

    ``extra`` names a column of search text that stands behind the document's own. ``options`` go to
    ``signals.extract_signals``.
    """
    body = pages.document_text(F.col(doc))
    if extra is not None:
        found = tx.strip(tx.text_or_empty(F.col(extra)))
        body = tx.let(body, lambda b: F.when(found == "", b).otherwise(F.concat(tx.rstrip(b), F.lit("\n\n[搜索补充]\n"), found)))
    df = signals.extract_signals(df.withColumn("text", body), "text", source, **options)
    return df.withColumns({
        "evidence_type": F.lit("structured_document"), "coverage": F.when(tx.text_or_empty(F.col("text")) != "", "full").otherwise("partial"),
        "fetch_warnings": ar.or_empty(F.col(warnings)),
    })
