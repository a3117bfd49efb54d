"""Steps, outline points and ranked chunks from text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.operators import lines as ln
from gleaner.operators import predicates as pr

NUMERAL = "[一二三四五六七八九十]+"
ENUM_ARABIC = r"^(\d{1,2})[.)、]\s*(.+)$"
ENUM_NTH = r"^第\s*(\d{1,2})\s*点[:：]?\s*(.+)$"
ENUM_CHINESE = r"^(十一|十二|十|[一二三四五六七八九])[、.）)]\s*(.+)$"


def ordinal(c: Column) -> Column:
    """Arabic or Chinese ordinal (1-12) as a number, else NULL."""
    table = F.create_map(*[F.lit(x) for pair in lx.CHINESE_ORDINALS.items() for x in pair])
    return F.coalesce(c.try_cast("int"), F.try_element_at(table, c))


def _is_step_heading(c: Column) -> Column:
    return c.rlike(f"^{NUMERAL}[、）]")


def step_items(text: Column, products: Iterable[str] = (), limit: int | None = None) -> Column:
    """array<struct<title,detail,command>>: numbered headings open a group."""
    label = "命令："
    products = tuple(products)

    def command_of(x: Column) -> Column:
        given = tx.normalize_command(F.substring(x, len(label) + 1, F.length(x)))
        direct = F.when((F.length(x) >= 6) & pr.is_command(x, products=products), tx.normalize_command(x))
        labelled = tx.let(given, lambda g: F.when(pr.is_command(g, products=products), g))
        return F.when(F.startswith(x, F.lit(label)), labelled).otherwise(direct)

    def is_detail(x: Column) -> Column:
        return (
            ~F.startswith(x, F.lit(label))
            & F.length(x).between(6, 140)
            & ~pr.is_command(x, products=products)
            & ~pr.is_ui_noise(x)
            & ~pr.is_step_noise(x)
            & ~tx.ends_any(x, ("：", ":"))
        )

    def item(g: Column) -> Column:
        details = ar.take(F.array_distinct(F.filter(g["items"], is_detail)), 3)
        commands = F.filter(F.transform(g["items"], command_of), lambda c: c.isNotNull() & (c != ""))
        return F.struct(
            g["head"].alias("title"),
            F.nullif(F.array_join(details, "；"), F.lit("")).alias("detail"),
            F.nullif(F.array_join(ar.take(commands, 2), " | "), F.lit("")).alias("command"),
        )

    return ar.take(F.transform(ln.groups_by_marker(ar.lines(text), _is_step_heading), item), limit)


def _real_command(c: Column, products: tuple[str, ...]) -> Column:
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (
        F.length(c).between(6, 180)
        & (spaces <= 24)
        & ~((F.length(c) > 90) & tx.contains_any(c, lx.STEP_COMMAND_PROSE))
        & ~F.lower(c).isin(*lx.STEP_COMMAND_STOPWORDS, *products)
        & tx.contains_any(c, (" ", "-", "/", "|", "\\", "http", "set-executionpolicy", "iwr", *products))
    )


def step_lines(text: Column, products: Iterable[str] = (), limit: int | None = None, part_chars: int = 260) -> Column:
    """Flat steps: headings, step lines, commands and numbered phrases inside a line.

    A phrase ends at white space or punctuation. Headings, commands and phrases of over
    ``part_chars`` characters are no steps; the line around them may be of any length.
    """
    label = "命令："
    products = tuple(products)

    def commands(x: Column) -> Column:
        parts = F.transform(ar.skip(F.split(x, label), 1), lambda p: tx.strip(p))
        return F.transform(F.filter(parts, lambda p: _real_command(p, products)), lambda p: F.concat(F.lit(label), p))

    def whole_command(x: Column) -> Column:
        given = tx.strip(F.substring(x, len(label) + 1, F.length(x)))
        return tx.let(
            given,
            lambda g: F.when(_real_command(g, products), F.array(F.concat(F.lit(label), g))).otherwise(ar.empty_strings()),
        )

    def phrases(x: Column) -> Column:
        return F.concat(
            F.regexp_extract_all(x, F.lit(f"({NUMERAL}、[^\\s，。；;：:]{{1,24}})"), 1),
            F.regexp_extract_all(x, F.lit(f"({NUMERAL}）[^\\s，。；;：:]{{1,24}})"), 1),
        )

    def of_line(x: Column) -> Column:
        return (
            F.when(x.rlike("^[一二三四五六七八九十][、）]"), F.when(F.length(x) <= part_chars, F.array(x)).otherwise(ar.empty_strings()))
            .when(F.startswith(x, F.lit("步骤")) & (F.length(x) <= 120), F.array(x))
            .when(F.startswith(x, F.lit(label)), whole_command(x))
            .otherwise(F.filter(F.concat(commands(x), phrases(x)), lambda p: F.length(p) <= part_chars))
        )

    return ar.take(F.flatten(F.transform(ar.lines(text), of_line)), limit)


def enumerated_points(text: Column, min_points: int = 3, max_points: int = 12) -> Column:
    """Contents of a gap-free enumeration, first line per number, in number order."""

    def parse(x: Column) -> Column:
        def part(i: int) -> Column:
            found = [F.nullif(F.regexp_extract(x, p, i), F.lit("")) for p in (ENUM_ARABIC, ENUM_NTH, ENUM_CHINESE)]
            return F.coalesce(*found)

        return F.struct(ordinal(part(1)).alias("n"), tx.strip(part(2)).alias("content"))

    lines = F.filter(F.transform(ar.lines(text), lambda x: tx.squash(x)), lambda x: (F.length(x) >= 4) & x.rlike(f"^(?:\\d|第|{NUMERAL})"))
    found = F.filter(
        F.transform(lines, parse), lambda e: e["n"].between(1, max_points) & (F.length(e["content"]) >= 2)
    )
    firsts = ln.first_by_key(found, lambda e: e["n"].cast("string"))
    ordered = F.sort_array(F.transform(firsts, lambda e: F.struct(e["n"].alias("n"), e["content"].alias("content"))))

    def accept(es: Column) -> Column:
        span = F.array_max(F.transform(es, lambda e: e["n"])) - F.array_min(F.transform(es, lambda e: e["n"])) + 1
        ok = (F.size(es) >= min_points) & (span == F.size(es))
        return F.when(ok, F.transform(es, lambda e: e["content"])).otherwise(ar.empty_strings())

    return tx.let(ordered, accept)


#: Headings that carry no content of their own.
GENERIC_HEADINGS = ("播放", "控制", "权限", "推荐", "用户互动", "基本信息", "标签", "页面", "概述", "结论", "证据")


def _at_least_two(points: Column, limit: int = 12) -> Column:
    return tx.let(points, lambda p: F.when(F.size(p) >= 2, ar.take(p, limit)).otherwise(ar.empty_strings()))


def section_points(sections: Column, generic: Iterable[str] = GENERIC_HEADINGS) -> Column:
    """Meaningful headings, or the start of the section text."""
    generic = tuple(generic)

    def point(s: Column) -> Column:
        heading = tx.squash(tx.text_or_empty(s["heading"]))
        content = tx.squash(tx.text_or_empty(s["content"]))
        good = (F.length(heading) >= 4) & ~tx.contains_any(heading, generic)
        return F.when(good, heading).when(F.length(content) >= 8, tx.rstrip(F.substring(content, 1, 48), "，。；; "))

    return _at_least_two(ar.keep_first(F.transform(sections, point)))


def step_points(items: Column) -> Column:
    def point(s: Column) -> Column:
        title = tx.squash(tx.text_or_empty(s["title"]))
        return F.when(title != "", title).otherwise(tx.squash(tx.text_or_empty(s["detail"])))

    return _at_least_two(ar.keep_first(F.transform(items, point)))


def timestamp_points(text: Column) -> Column:
    lines = F.transform(ar.lines(text), lambda x: tx.squash(x))
    body = F.transform(lines, lambda x: tx.strip(F.regexp_extract(x, r"^\[\d{1,2}:\d{2}(?::\d{2})?\]\s*(.+)$", 1)))
    return _at_least_two(ar.keep_first(F.filter(body, lambda x: F.length(x) >= 4)))


def sequence_points(text: Column) -> Column:
    """What follows first / then / finally."""
    patterns = (r"(?:首先|先)([^。；\n]{2,60})", r"(?:其次|再|然后)([^。；\n]{2,60})", r"(?:最后|最终)([^。；\n]{2,60})")
    compact = tx.squash(tx.text_or_empty(text))
    found = F.array(*[tx.strip(F.regexp_extract(compact, p, 1), " ，,：:;；") for p in patterns])
    return _at_least_two(ar.keep_first(found))


def outline_points(sections: Column, items: Column, texts: list[Column], story: Column, fallback_text: Column) -> Column:
    """First non-empty of sections, steps, enumeration, story blocks and sequence words."""
    options = [section_points(sections), step_points(items)]
    options += [enumerated_points(t) for t in texts] + [ar.or_empty(story), sequence_points(fallback_text)]
    return F.coalesce(*[tx.let(o, lambda p: F.when(F.size(p) > 0, ar.take(p, 12))) for o in options], ar.empty_strings())


RANK = "十一|十二|十|[一二三四五六七八九]|\\d{1,2}"


def ranked_chunks(text: Column) -> Column:
    """array<struct<rank,content>> of ``第N名 …`` chunks, first per rank, highest rank first."""
    found = F.regexp_extract_all(
        tx.text_or_empty(text), F.lit(rf"(第\s*(?:{RANK})\s*名.*?)(?=第\s*(?:{RANK})\s*名|好了以上|$)"), 1
    )
    head = rf"^第\s*({RANK})\s*名"
    parsed = F.transform(
        found,
        lambda c: F.struct(
            ordinal(F.regexp_extract(c, head, 1)).alias("rank"),
            tx.squash(tx.strip(F.regexp_replace(c, head, ""), " ：:，,。.;；!?！？")).alias("content"),
        ),
    )
    usable = F.filter(parsed, lambda e: e["rank"].isNotNull() & (e["content"] != ""))
    firsts = ln.first_by_key(usable, lambda e: e["rank"].cast("string"))
    return F.sort_array(firsts, asc=False)
