"""Pages: article text and document structure from raw HTML, inside the row.

No DOM is built. Elements are told by the running depth of tags of their name: noise
elements go first, the main part is one element; block-start tags cut it into pieces,
and a block ends at the next block tag, so unclosed tags do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.config import PageLimits
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import predicates as pr
from gleaner.operators.lines import groups_by_marker

_START, _MID = "\x01", "\x02"
CONTENT_CLASSES = "article|content|post|entry|rich_media_content|note-content"


#: A tag, its attribute values in quotes of either kind or none.
TAG = r"<[a-zA-Z/](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Elements whose content is raw text, so they end at their first close tag.
RAW_TEXT = ("script", "style", "noscript")
# Containers of the main part, in order of preference.
CONTAINERS = (
    r"\bdata-testid=[\"']readme[\"']",
    r"\bclass=[\"'](?:[^\"']*\s)?markdown-body(?:\s[^\"']*)?[\"']",
    r"\brole=[\"']main[\"']",
    r"\bclass=[\"'](?:[^\"']*\s)?body(?:\s[^\"']*)?[\"']",
    r"\bclass=[\"'](?:[^\"']*\s)?document(?:\s[^\"']*)?[\"']",
    r"^<article\b",
    r"^<main\b",
)


def _tags(tags: Column) -> Column:
    """array<struct<tag,name,close,void>>: what the folds ask of a tag, worked out once."""
    def one(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, "^</?([a-zA-Z0-9:-]+)", 1))
        return tx.let(name, lambda n: F.struct(
            t.alias("tag"), n.alias("name"), F.startswith(t, F.lit("</")).alias("close"), (F.endswith(t, F.lit("/>")) | n.isin(*VOID)).alias("void")))

    return F.transform(tags, one)


#: Tags of a block of the fold.
_BLOCK = 128


def _marked(tags: Column, target: Callable[[Column], Column]) -> Column:
    """The tags with ``hit``: whether ``target`` selects them."""
    return F.transform(tags, lambda t: F.struct(
        t["name"].alias("name"), t["close"].alias("close"), t["void"].alias("void"), (~t["close"] & ~t["void"] & target(t["tag"])).alias("hit")))


def _step(acc: Column, x: Column) -> tuple[Column, Column, Column]:
    """(opens, name, depth) after tag ``x``: the element that ``acc`` is in ends where its depth returns to zero."""
    same = (acc["depth"] > 0) & (x["name"] == acc["name"]) & ~x["void"]
    opens = (acc["depth"] == 0) & x["hit"]
    depth = F.when(opens, 1).when(same & x["close"], acc["depth"] - 1).when(same, acc["depth"] + 1).otherwise(acc["depth"])
    return opens, F.when(opens, x["name"]).otherwise(acc["name"]), depth


def _elements(marked: Column) -> Column:
    """array<struct<first,last>>: places of the open and close tags of the outermost elements that open with a hit.

    The element ends where as many tags of its name are closed as were opened since. One that
    is never closed isn't an element. A fold copies what it carries at every step, so one over blocks of
    tags carries the elements found so far, and one within a block only those of the block.
    """
    none = F.array().cast("array<struct<first:int,last:int>>")

    def state(name: Column, depth: Column, at: Column, first: Column, found: Column) -> Column:
        return F.struct(name.alias("name"), depth.alias("depth"), at.alias("at"), first.alias("first"), found.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        opens, name, depth = _step(acc, x)
        ended = (acc["depth"] > 0) & (depth == 0)
        found = F.when(ended, F.concat(acc["found"], F.array(F.struct(acc["first"].alias("first"), acc["at"].alias("last"))))).otherwise(acc["found"])
        return state(name, depth, acc["at"] + 1, F.when(opens, acc["at"]).otherwise(acc["first"]), found)

    def block(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(marked, k * _BLOCK + 1, F.lit(_BLOCK)), state(acc["name"], acc["depth"], acc["at"], acc["first"], none), step)
        return tx.let(inner, lambda i: state(i["name"], i["depth"], i["at"], i["first"], F.concat(acc["found"], i["found"])))

    start = state(F.lit(""), F.lit(0), F.lit(0), F.lit(0), none)
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(marked) / _BLOCK).cast("int")), start, block, lambda acc: acc["found"])


def _first_element(marked: Column) -> Column:
    """struct(first, last) of the first closed element that opens with a hit; ``last`` is -1 without one."""
    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        opens, name, depth = _step(acc, x)
        last = F.when((acc["last"] < 0) & (acc["depth"] > 0) & (depth == 0), acc["at"]).otherwise(acc["last"])
        first = F.when(opens & (acc["last"] < 0), acc["at"]).otherwise(acc["first"])
        return F.struct(name.alias("name"), depth.alias("depth"), (acc["at"] + 1).alias("at"), first.alias("first"), last.alias("last"))

    return F.aggregate(marked, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _parts(html: Column) -> Column:
    """struct(tags, gaps): the tags and the text before, between and behind them."""
    return F.struct(_tags(F.regexp_extract_all(html, F.lit(TAG), 0)).alias("tags"), F.split(html, TAG, -1).alias("gaps"))


def _run(p: Column, first: Column, last: Column) -> Column:
    """The text from tag ``first`` to tag ``last`` with the gaps behind them."""
    tags = F.slice(p["tags"], first + 1, F.greatest(last - first + 1, F.lit(0)))
    return F.array_join(F.transform(tags, lambda t, i: F.concat(t["tag"], F.get(p["gaps"], first + i + 1))), "")


def cut_elements(html: Column, target: Callable[[Column], Column]) -> Column:
    """HTML without the elements that ``target`` selects by their open tag, with all that is in them."""

    def kept(p: Column) -> Column:
        def between(found: Column) -> Column:
            # From each cut element's end to the next one's start; a space stands for the element.
            later = F.transform(found, lambda e, k: F.concat(
                F.lit(" "), F.get(p["gaps"], e["last"] + 1), _run(p, e["last"] + 1, F.coalesce(F.get(found, k + 1)["first"], F.size(p["tags"])) - 1)))
            head = F.concat(F.get(p["gaps"], F.lit(0)), _run(p, F.lit(0), F.coalesce(F.get(found, F.lit(0))["first"], F.size(p["tags"])) - 1))
            return F.concat(head, F.array_join(later, ""))

        return tx.let(_marked(p["tags"], target), lambda m: F.when(F.exists(m, lambda x: x["hit"]), tx.let(_elements(m), between)))

    return tx.let(_parts(html), lambda p: F.coalesce(kept(p), html))


def _inner(p: Column, target: Callable[[Column], Column]) -> Column:
    """Content of the first closed element that ``target`` selects; null without one."""
    return tx.let(_first_element(_marked(p["tags"], target)), lambda e: F.when(
        e["last"] > e["first"], F.concat(F.get(p["gaps"], e["first"] + 1), _run(p, e["first"] + 1, e["last"] - 1))))


def without_noise(html: Column) -> Column:
    """HTML without noise elements, noise classes and comments; nested ones go with theirs."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in RAW_TEXT:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    names = "|".join(t for t in lx.PAGE_NOISE_TAGS if t not in RAW_TEXT)
    classes = "|".join(lx.PAGE_NOISE_CLASSES)
    noisy = rf"(?is)^<(?:(?:{names})\b|\w[^>]*\bclass=[\"'](?:[^\"']*\s)?(?:{classes})(?:\s[^\"']*)?[\"'])"
    return tx.let(c, lambda v: F.when(
        v.rlike(rf"(?i)<(?:{names})\b|class=[\"'][^\"']*(?:{classes})"), cut_elements(v, lambda t: t.rlike(noisy))
    ).otherwise(v))


def main_part(html: Column) -> Column:
    """Content of the first primary container in order of preference, from its open tag to its own close tag.

    Tags are cut out once for all containers; a container that no tag names costs one look at the page.
    """
    def body(h: Column) -> Column:
        def inside(p: Column) -> Column:
            def option(pattern: str) -> Column:
                named = h.rlike("(?is)" + (pattern[1:] if pattern.startswith("^") else pattern))
                return F.when(named, F.nullif(_inner(p, lambda t: t.rlike("(?is)" + pattern)), F.lit("")))

            return F.coalesce(*[option(pattern) for pattern in CONTAINERS])

        marked = h.rlike("(?i)data-testid=|markdown-body|role=[\"']main|class=[\"'][^\"']*(?:body|document)|<article|<main")
        rest = F.nullif(F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*)", 1), F.lit(""))
        return F.coalesce(F.when(marked, tx.let(_parts(h), inside)), rest, h)

    return tx.let(html, body)


def blocks(main: Column) -> Column:
    """array<struct<tag,text>>: headings, paragraphs and list items in page order."""
    marked = F.regexp_replace(main, r"(?i)<(h[1-6]|p|li)\b[^>]*>", f"{_START}$1{_MID}")
    pieces = ar.skip(F.split(marked, _START), 1)

    def piece(p: Column) -> Column:
        body = F.substring(p, F.instr(p, _MID) + 1, F.length(p))
        body = F.regexp_replace(body, r"(?is)</(?:h[1-6]|p|li)\s*>.*$", "")
        return F.struct(
            F.lower(F.substring_index(p, _MID, 1)).alias("tag"),
            tx.squash(tx.unescape(F.regexp_replace(body, "<[^>]+>", " "))).alias("text"),
        )

    return F.filter(F.transform(pieces, piece), lambda b: ~pr.is_page_noise(b["text"]))


def _is_heading(b: Column) -> Column:
    return F.startswith(b["tag"], F.lit("h"))


def sections_of(page_blocks: Column) -> Column:
    """Carry the last heading forward: array<struct<heading,level,content>>."""

    def section(g: Column) -> Column:
        return F.struct(
            g["head"]["text"].alias("heading"),
            F.substring(g["head"]["tag"], 2, 1).cast("int").alias("level"),
            F.array_join(F.transform(g["items"], lambda b: b["text"]), "\n\n").alias("content"),
        )

    return F.filter(F.transform(groups_by_marker(page_blocks, _is_heading), section), lambda s: s["content"] != "")


def _attr(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return tx.squash(tx.unescape(quoted))


def _clipped(c: Column, limit: int | None) -> Column:
    return c if limit is None else tx.clip(c, limit)


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def images_of(main: Column, base: Column, limit: int | None = None) -> Column:
    tags = F.filter(F.regexp_extract_all(main, F.lit(r"(?is)<img\b[^>]*>"), 0), lambda t: _attr(t, "src") != "")
    found = F.transform(
        tags,
        lambda t: F.struct(
            urls.resolve(base, _attr(t, "src")).alias("src"),
            _some(_attr(t, "alt")).alias("alt"),
            F.lit(None).cast("string").alias("caption"),
            F.lit(None).cast("string").alias("context"),
        ),
    )
    return ar.take(F.filter(found, lambda i: ~pr.is_decorative(i["src"], i["alt"])), limit)


def videos_of(main: Column, base: Column, limit: int | None = None) -> Column:
    tags = F.regexp_extract_all(main, F.lit(r"(?is)<video\b[^>]*>.*?</video\s*>|<video\b[^>]*>|<iframe\b[^>]*>"), 0)

    def video(t: Column) -> Column:
        opening = F.regexp_extract(t, r"(?s)^<[^>]*>", 0)
        nested = F.regexp_extract(t, r"(?is)<source\b[^>]*>", 0)
        src = F.coalesce(_some(_attr(opening, "src")), _some(_attr(nested, "src")))
        frame = F.startswith(F.lower(t), F.lit("<iframe"))
        poster = F.when(~frame, _some(_attr(opening, "poster")))
        full = urls.resolve(base, src)
        return F.struct(
            full.alias("src"),
            F.when(poster.isNotNull(), urls.resolve(base, poster)).alias("poster"),
            urls.video_provider(full).alias("provider"),
            F.lit(None).cast("double").alias("duration_seconds"),
            ar.empty_strings().alias("frame_summaries"),
            (src.isNotNull() & (~frame | tx.contains_any(F.lower(src), lx.EMBED_PROVIDERS))).alias("ok"),
        )

    found = F.filter(F.transform(tags, video), lambda v: v["ok"])
    return ar.take(F.transform(found, lambda v: v.dropFields("ok")), limit)


def _cells(fragment: Column, names: str) -> Column:
    raw = F.regexp_extract_all(fragment, F.lit(rf"(?is)<(?:{names})\b[^>]*>(.*?)(?=</(?:{names})\s*>|<t[dhr]\b|$)"), 1)
    return F.filter(F.transform(raw, lambda x: tx.squash(tx.unescape(F.regexp_replace(x, "<[^>]+>", " ")))), lambda x: x != "")


def tables_of(main: Column, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(main, F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), 1)

    def table(t: Column) -> Column:
        caption = F.regexp_extract(t, r"(?is)<caption\b[^>]*>(.*?)</caption\s*>", 1)
        rows = F.filter(
            F.transform(ar.skip(F.split(t, r"(?i)<tr\b[^>]*>"), 1), lambda r: _cells(r, "td|th")),
            lambda r: F.size(r) > 0,
        )
        return F.struct(
            _some(tx.squash(tx.unescape(F.regexp_replace(caption, "<[^>]+>", " ")))).alias("caption"),
            _cells(t, "th").alias("headers"),
            rows.alias("rows"),
        )

    kept = F.filter(F.transform(found, table), lambda t: (F.size(t["headers"]) > 1) | (F.size(t["rows"]) > 1))
    return ar.take(kept, limit)


def structure_pages(
    pages: DataFrame,
    html: str = "html",
    url: str = "url",
    hint: str | None = None,
    limits: PageLimits = PageLimits(),
) -> DataFrame:
    """Add ``doc``: struct(title, main_text, sections, images, videos, tables)."""
    df = pages.withColumn("_clean", without_noise(F.col(html)))
    df = df.withColumn("_main", main_part(F.col("_clean")))
    df = df.withColumn("_blocks", blocks(F.col("_main")))
    title_tag = F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = tx.squash(tx.unescape(F.regexp_replace(title_tag, "<[^>]+>", " ")))
    main_text = F.array_join(F.transform("_blocks", lambda b: b["text"]), "\n\n")
    hint_text = tx.squash(tx.text_or_empty(F.col(hint))) if hint else F.lit("")
    df = df.withColumns(
        {
            "_title": F.when(title == "", F.lit("Untitled page")).otherwise(title),
            "_sections": sections_of(F.col("_blocks")),
            "_text": main_text,
        }
    )
    fallback_body = F.when(
        F.col("_text") != "", _clipped(tx.squash(F.col("_text")), limits.fallback_section_chars)
    ).otherwise(hint_text)
    fallback = F.array(
        F.struct(F.col("_title").alias("heading"), F.lit(1).alias("level"), fallback_body.alias("content"))
    )
    sections = F.when((F.size("_sections") == 0) & (fallback_body != ""), fallback).otherwise(F.col("_sections"))
    base = F.col(url)
    doc = F.struct(
        F.col("_title").alias("title"),
        F.when(F.col("_text") == "", hint_text).otherwise(F.col("_text")).alias("main_text"),
        sections.alias("sections"),
        images_of(F.col("_main"), base, limits.max_images).alias("images"),
        videos_of(F.col("_main"), base, limits.max_videos).alias("videos"),
        tables_of(F.col("_main"), limits.max_tables).alias("tables"),
    )
    return df.withColumn("doc", doc).drop("_clean", "_main", "_blocks", "_title", "_sections", "_text")


def extractive_document(doc: Column, limit: int = 220) -> Column:
    """Document whose summary is the first two section bodies, or the main text."""
    first = F.filter(
        F.transform(ar.take(doc["sections"], 2), lambda s: tx.strip(s["content"])), lambda x: x != ""
    )
    joined = tx.strip(F.array_join(first, " "))
    body = F.when(joined == "", tx.strip(doc["main_text"])).otherwise(joined)
    note = F.lit("页面渲染成功，但未能从模型获取结构化总结，已返回本地抽取结果。")
    return F.struct(
        doc["title"].alias("title"),
        F.when(body == "", note).otherwise(tx.clip(body, limit)).alias("summary"),
        *[doc[n].alias(n) for n in ("sections", "images", "videos", "tables")],
    )


def child_table(df: DataFrame, page_id: str, name: str) -> DataFrame:
    """One row per section, image, video or table of a structured page."""
    return ar.explode_rows(df, page_id, F.col("doc")[name], "item").select(page_id, "ord", "item.*")


def document_text(doc: Column, sections: int = 6, images: int = 4, videos: int = 3, tables: int = 3, rows: int = 2) -> Column:
    """Labelled plain-text rendering of a document, capped per part."""

    def labelled(label: str, c: Column) -> Column:
        c = tx.strip(tx.text_or_empty(c))
        return F.when(c != "", F.concat(F.lit(label), c)).otherwise(F.lit(""))

    def headed(head: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(ar.strings(head), items)).otherwise(ar.empty_strings())

    def present(arr: Column) -> Column:
        return F.filter(F.transform(arr, lambda x: tx.strip(tx.text_or_empty(x))), lambda x: x != "")

    def section(s: Column) -> Column:
        heading, content = tx.strip(tx.text_or_empty(s["heading"])), tx.strip(tx.text_or_empty(s["content"]))
        return (
            F.when(content == "", F.lit(""))
            .when(heading == "", content)
            .otherwise(F.concat(heading, F.lit(": "), content))
        )

    def image(i: Column) -> Column:
        return F.array_join(present(F.array(i["caption"], i["alt"], i["context"], i["src"])), " | ")

    def video(v: Column) -> Column:
        seconds = F.when(
            v["duration_seconds"].isNotNull(),
            F.concat(F.lit("时长: "), F.round(v["duration_seconds"], 1).cast("string"), F.lit(" 秒")),
        )
        head = F.array_join(present(F.array(labelled("来源: ", v["provider"]), seconds, labelled("链接: ", v["src"]))), " | ")
        return F.concat(F.array(head), present(ar.take(v["frame_summaries"], 3)))

    def table(t: Column) -> Column:
        header = F.array_join(present(t["headers"]), " | ")
        body = F.transform(ar.take(t["rows"], rows), lambda r: labelled("行: ", F.array_join(present(r), " | ")))
        return F.concat(F.array(labelled("表格标题: ", t["caption"]), labelled("表头: ", header)), body)

    lines = F.concat(
        F.array(labelled("标题: ", doc["title"]), labelled("摘要: ", doc["summary"])),
        headed("[章节]", F.transform(ar.take(doc["sections"], sections), section)),
        headed("[图片]", F.transform(ar.take(doc["images"], images), image)),
        headed("[视频]", F.flatten(F.transform(ar.take(doc["videos"], videos), video))),
        headed("[表格]", F.flatten(F.transform(ar.take(doc["tables"], tables), table))),
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def article_text(html: Column, url: Column) -> Column:
    """Readable text: preferred block, longest block, long paragraphs, whole body.

    On the one site whose pages carry their text in the description, a usable
    description wins.
    """
    preferred = tx.html_to_text(F.regexp_extract(html, r"(?is)<div[^>]+id=[\"']js_content[\"'][^>]*>(.*?)</div>", 1))
    found = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?is)<article\b[^>]*>(.*?)</article>"), 1),
        F.regexp_extract_all(html, F.lit(r"(?is)<main\b[^>]*>(.*?)</main>"), 1),
        F.regexp_extract_all(
            html,
            F.lit(rf"(?is)<div[^>]+class=[\"'][^\"']*(?:{CONTENT_CLASSES})[^\"']*[\"'][^>]*>(.*?)</div>"),
            1,
        ),
    )
    texts = F.filter(F.transform(found, tx.html_to_text), lambda t: F.length(t) >= 40)
    ranked = F.sort_array(F.transform(texts, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    longest = F.try_element_at(F.transform(ranked, lambda e: e["t"]), F.lit(1))
    paragraphs = F.filter(
        F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), tx.html_to_text),
        lambda t: F.length(t) >= 20,
    )
    joined = F.nullif(F.array_join(paragraphs, "\n\n"), F.lit(""))
    body = F.coalesce(F.nullif(preferred, F.lit("")), longest, joined, tx.html_to_text(html))
    description = tx.meta_description(html)
    described = F.contains(tx.text_or_empty(url), F.lit("xiaohongshu.com")) & description.isNotNull()
    return F.when(described & ~pr.is_legal_footer(description), description).otherwise(body)
