"""Text, search hits and reader remarks from accessibility-snapshot logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.operators import lines as ln
from gleaner.operators import predicates as pr

NODE = r"^- (?:generic|paragraph|heading|article|listitem|blockquote)\b.*?:\s*(.+)$"
LINK = r'- link "([^"]+)"'
URL = r"/url:\s*(https?://\S+)"
TEXT = r"- text:\s*(.+)$"
HEADING = r'heading "([^"]+)"'


def parse_lines(snapshot: Column) -> Column:
    """array<struct<kind,value,indent>> in log order. ``kind`` is url, text, link, heading, code, paragraph, node or other."""

    def parse(raw: Column) -> Column:
        line = tx.strip(raw)
        found = {
            "url": F.nullif(F.regexp_extract(line, URL, 1), F.lit("")),
            "text": F.nullif(F.regexp_extract(line, TEXT, 1), F.lit("")),
            "link": F.nullif(F.regexp_extract(line, LINK, 1), F.lit("")),
            "heading": F.nullif(F.regexp_extract(line, HEADING, 1), F.lit("")),
            "code": F.nullif(F.regexp_extract(line, r"- code\b.*?:\s*(.+)$", 1), F.lit("")),
            "node": F.nullif(F.regexp_extract(line, NODE, 1), F.lit("")),
        }
        # A paragraph line may carry its text inline; either way it opens a paragraph.
        kind = F.coalesce(
            F.when(F.startswith(line, F.lit("- paragraph")), F.lit("paragraph")),
            *[F.when(v.isNotNull(), F.lit(k)) for k, v in found.items()],
            F.lit("other"),
        )
        indent = F.length(raw) - F.length(F.ltrim(raw))
        return F.struct(kind.alias("kind"), F.coalesce(*found.values(), F.lit("")).alias("value"), indent.alias("indent"))

    raw = F.filter(F.split(tx.text_or_empty(snapshot), tx.LINE_BREAK), lambda x: tx.strip(x) != "")
    return F.transform(raw, parse)


def read_lines(df: DataFrame, doc_id: str, snapshot: str) -> DataFrame:
    """(doc_id, pos, kind, value, indent) rows."""
    return ar.explode_rows(df, doc_id, parse_lines(F.col(snapshot)), "l", "pos").select(doc_id, "pos", "l.*")


def _clean_url(c: Column) -> Column:
    return tx.rstrip(c, ")]}>,.;")


def snapshot_text(snapshot: Column) -> Column:
    """Readable body of a page snapshot plus up to six high-value links."""

    def body(entries: Column) -> Column:
        texts = F.transform(
            F.filter(entries, lambda e: e["kind"].isin("text", "node", "paragraph")),
            lambda e: F.struct(tx.normalize(e["value"]).alias("v"), e["kind"].alias("k")),
        )
        kept = F.filter(
            texts,
            lambda t: (t["v"] != "") & ((t["k"] == "text") | (F.length(t["v"]) >= 8)) & ~pr.is_line_noise(t["v"]),
        )
        values = F.array_distinct(F.transform(kept, lambda t: t["v"]))
        links = F.transform(F.filter(entries, lambda e: e["kind"] == "url"), lambda e: _clean_url(e["value"]))
        links = ar.take(F.array_distinct(F.filter(links, lambda u: pr.is_high_value_link(u))), 6)

        def assemble(vs: Column, us: Column) -> Column:
            long_ones = F.filter(vs, lambda v: F.length(v) >= 12)
            chosen = F.when(F.size(long_ones) > 0, ar.take(long_ones, 6)).otherwise(ar.take(vs, 8))
            main = F.array_join(chosen, "\n\n")
            tail = F.array_join(us, "\n")
            return (
                F.when(F.size(vs) == 0, tail)
                .when(F.size(us) == 0, main)
                .otherwise(F.concat(main, F.lit("\n\n相关链接：\n"), tail))
            )

        return tx.let(values, lambda vs: tx.let(links, lambda us: assemble(vs, us)))

    return tx.let(parse_lines(snapshot), body)


def snapshot_hits(snapshot: Column, limit: int = 5) -> Column:
    """array<struct<title,url,snippet>> of a result page: a link opens a hit."""

    def hit(g: Column) -> Column:
        urls = F.filter(g["items"], lambda e: e["kind"] == "url")
        words = F.transform(F.filter(g["items"], lambda e: e["kind"].isin("text", "node")), lambda e: tx.squash(e["value"]))
        return F.struct(
            tx.squash(g["head"]["value"]).alias("title"),
            _clean_url(F.try_element_at(F.transform(urls, lambda e: e["value"]), F.lit(1))).alias("url"),
            F.substring(tx.squash(F.array_join(words, " ")), 1, 400).alias("snippet"),
        )

    groups = ln.groups_by_marker(parse_lines(snapshot), lambda e: e["kind"] == "link")
    hits = F.filter(F.transform(groups, hit), lambda h: h["url"].isNotNull())
    return ar.take(ln.first_by_key(hits, lambda h: h["url"]), limit)


#: Section titles and controls of the comment area.
COMMENT_HEADING = "评论"
COMMENT_STOP = ("相关推荐", "大家都在搜", "返回顶部", "点击关闭迷你播放器")
COMMENT_CONTROLS = ("最热", "最新", "回复", "评论")


def _author_name(e: Column) -> Column:
    """Name behind a link that can introduce a remark, else NULL."""
    name = tx.normalize(e["value"])
    usable = (
        (e["kind"] == "link")
        & ~name.isin(*COMMENT_CONTROLS)
        & ~tx.starts_any(name, ("http://", "https://"))
        & ~tx.contains_any(name, (COMMENT_HEADING, "自动化交易"))
    )
    return F.when(usable, name)


def _last(names: Column) -> Column:
    return F.try_element_at(F.filter(names, lambda x: x.isNotNull()), F.lit(-1))


def snapshot_comments(snapshot: Column, owner: Column, limit: int = 5) -> Column:
    """Substantial reader remarks inside the comment section.

    A paragraph joins the text and links indented below it. A link outside a
    paragraph names the author of what follows, so the part of a group behind its
    paragraph belongs to the next one.
    """
    area = ln.between_markers(
        parse_lines(snapshot),
        lambda e: (e["kind"] == "heading") & (e["value"] == COMMENT_HEADING),
        lambda e: tx.contains_any(e["value"], COMMENT_STOP),
    )

    def is_paragraph(e: Column) -> Column:
        return e["kind"] == "paragraph"

    def group(g: Column) -> Column:
        level = g["head"]["indent"]
        outside = F.transform(g["items"], lambda e: (e["indent"] <= level) & (e["kind"] != "text"))
        cut = F.coalesce(F.nullif(F.array_position(outside, F.lit(True)), F.lit(0).cast("long")), F.size(outside) + 1)
        pieces = F.filter(ar.take(g["items"], (cut - 1).cast("int")), lambda e: e["kind"].isin("text", "link"))
        behind = ar.skip(g["items"], (cut - 1).cast("int"))
        return F.struct(
            tx.normalize(F.concat(g["head"]["value"], F.array_join(F.transform(pieces, lambda e: e["value"]), ""))).alias("text"),
            _last(F.transform(behind, _author_name)).alias("next_author"),
        )

    def remarks(entries: Column, groups: Column) -> Column:
        lead = ln.until_first(entries, F.transform(entries, is_paragraph))
        names = F.concat(F.array(_last(F.transform(lead, _author_name))), F.transform(groups, lambda g: g["next_author"]))
        authored = tx.let(
            names,
            lambda ns: F.transform(
                groups, lambda g, k: F.struct(g["text"].alias("text"), _last(F.slice(ns, 1, k + 1)).alias("author"))
            ),
        )
        kept = F.filter(authored, lambda c: pr.is_feedback(c["text"], c["author"], owner))
        return ar.take(F.array_distinct(F.transform(kept, lambda c: c["text"])), limit)

    return tx.let(
        area,
        lambda es: tx.let(
            F.transform(ln.groups_by_marker(es, is_paragraph), group), lambda gs: remarks(es, gs)
        ),
    )


def tutorial_text(snapshot: Column, start: Iterable[str], stop: Iterable[str], limit: int | None = None) -> Column:
    """Lines between a start heading and a stop token, commands labelled."""
    start, stop = tuple(start), tuple(stop)
    area = ln.between_markers(
        parse_lines(snapshot),
        lambda e: (e["kind"] == "heading") & tx.contains_any(e["value"], start),
        lambda e: tx.contains_any(e["value"], stop),
    )
    lines = F.transform(
        F.filter(area, lambda e: e["kind"].isin("heading", "text", "code", "node", "paragraph")),
        lambda e: F.when(e["kind"] == "code", F.concat(F.lit("命令："), tx.normalize(e["value"]))).otherwise(
            tx.normalize(e["value"])
        ),
    )
    kept = F.filter(lines, lambda x: ~pr.is_ui_noise(x) & ~F.startswith(x, F.lit("发布于")))
    return F.array_join(ar.take(F.array_distinct(kept), limit), "\n")


def sanitize_media_page(
    text: Column, title: Column,
    low_value: Iterable[str] = lx.MEDIA_PAGE_LOW_VALUE,
    signals: Iterable[str] = lx.MEDIA_PAGE_SIGNALS,
    chatter: Iterable[str] = lx.MEDIA_PAGE_CHATTER,
    noise=pr.is_line_noise,
    limit: int = 8,
) -> Column:
    """Strong lines of a media page; with none, lines that share a word with the title."""
    low_value, signals, chatter = tuple(low_value), tuple(signals), tuple(chatter)

    def keep(x: Column) -> Column:
        signal = tx.contains_any(F.lower(x), signals)
        weak = (
            tx.contains_any(x, chatter)
            | x.rlike("[？?]$")
            | (F.length(x) < 10)
            | x.rlike(r"^[A-Za-z0-9\s\-_/.:]+$")
        )
        return (
            ~noise(x)
            & ~x.rlike(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}$")
            & ~x.rlike(r"^\d{1,2}:\d{2}(?:\s*/\s*\d{1,2}:\d{2})?$")
            & ~tx.contains_any(x, low_value)
            & (signal | ~weak)
        )

    def body(xs: Column, name: Column) -> Column:
        head = F.when(name != "", F.array(name)).otherwise(ar.empty_strings())
        strong = F.transform(F.filter(xs, lambda x: (x != name) & keep(x)), lambda x: tx.clip(x, 180))
        first = ar.take(F.array_distinct(F.concat(head, strong)), limit)
        terms = F.filter(F.split(name, r"[\s/|_\-]+"), lambda t: F.length(t) >= 2)
        related = F.filter(xs, lambda x: (x != name) & F.exists(terms, lambda t: F.contains(x, t)))
        more = ar.take(F.concat(first, F.transform(related, lambda x: tx.clip(x, 180))), 4)
        return F.array_join(F.when((F.size(first) <= 1) & (name != ""), more).otherwise(first), "\n")

    lines = F.filter(F.transform(ar.lines(text), tx.normalize), lambda x: x != "")
    return tx.let(lines, lambda xs: tx.let(tx.media_title(title), lambda name: body(xs, name)))
