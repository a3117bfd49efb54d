"""Text expressions. Everything returns a Column and stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters removed by ``strip``: every Unicode white-space character.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: Line terminators, CRLF counting once.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CJK = "[\\u4e00-\\u9fff]"
SLUG = r"(?U)\b[a-z][a-z0-9]+(?:-[a-z0-9]+){1,5}\b"
TIMESTAMP_PREFIX = r"^\[[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\]"

#: Named and numeric references that occur in page text.
#: Named character references, as the standard library lists them.
NAMED_REFERENCES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"


_PLAIN = re.compile(r"Column<'[\w.]+(?:\['?\w+'?\])*'>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name for ``body``.

    Expressions are trees, so a rule that reads its argument n times repeats the
    argument n times, and rules on rules grow exponentially. The binding keeps
    trees small and evaluates the argument once. Plain columns need no binding.
    """
    if _PLAIN.fullmatch(repr(value)):
        return body(value)
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def rstrip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(c, F.lit(chars))


def lstrip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.ltrim(c, F.lit(chars))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squash(c: Column) -> Column:
    """Trim and collapse white space to single blanks."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def drop_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def any_of(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def alternation(tokens: Iterable[str]) -> str:
    """Regular expression matching any of the literal tokens.

    A look-ahead on the first characters rejects most positions in one step.
    """
    tokens = sorted(set(tokens), key=lambda t: (-len(t), t))
    quoted = [re.sub(r"([^\w\s])", r"\\\1", t) for t in tokens]
    firsts = "".join(sorted({re.sub(r"([^\w\s])", r"\\\1", t[0]) for t in tokens}))
    return f"(?=[{firsts}])(?:{'|'.join(quoted)})"


def _matches(c: Column, tokens: Iterable[str], template: str, simple: Callable[[Column, Column], Column]) -> Column:
    tokens = [t for t in dict.fromkeys(tokens) if t]
    if len(tokens) < 3:
        return any_of(simple(c, F.lit(t)) for t in tokens)
    return c.rlike(template.format(alternation(tokens)))


def contains_any(c: Column, tokens: Iterable[str]) -> Column:
    return _matches(c, tokens, "{}", F.contains)


def starts_any(c: Column, tokens: Iterable[str]) -> Column:
    return _matches(c, tokens, "^{}", F.startswith)


def ends_any(c: Column, tokens: Iterable[str]) -> Column:
    return _matches(c, tokens, r"{}\z", F.endswith)


def equals_any(c: Column, tokens: Iterable[str]) -> Column:
    return _matches(c, tokens, r"^{}\z", lambda a, b: a == b)


def count_contained(c: Column, tokens: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(t)).cast("int") for t in tokens], F.lit(0))


def has_slug(c: Column) -> Column:
    """Does the text hold a hyphenated lower-case name? A hyphen is looked for first."""
    return F.contains(c, F.lit("-")) & c.rlike(SLUG)


def unescape(c: Column) -> Column:
    """Decode character references, named and numeric; text without ``&`` passes through.

    Unknown names and numbers that are no character stay as they are.
    """
    named = F.str_to_map(F.lit("\x02".join(f"{k}\x03{v}" for k, v in NAMED_REFERENCES.items())), F.lit("\x02"), F.lit("\x03"))

    def one(ref: Column) -> Column:
        code = F.when(
            ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 6), 16, 10)
        ).otherwise(F.substring(ref, 2, 7)).try_cast("int")
        usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.startswith(ref, F.lit("#")), F.when(usable, sign)).otherwise(F.try_element_at(named, ref))

    def decode(v: Column) -> Column:
        refs, gaps = F.regexp_extract_all(v, F.lit(REFERENCE), 1), F.split(v, REFERENCE, -1)
        return let(F.struct(refs.alias("r"), gaps.alias("g")), lambda x: F.concat(
            F.get(x["g"], F.lit(0)),
            F.array_join(F.transform(x["r"], lambda ref, i: F.concat(
                F.coalesce(one(ref), F.concat(F.lit("&"), ref, F.lit(";"))), F.get(x["g"], i + 1)
            )), ""),
        ))

    return let(c, lambda v: F.when(v.rlike(REFERENCE), decode(v)).otherwise(v))


def normalize(c: Column) -> Column:
    """Decode, unify line ends, limit blank lines, collapse blanks and trim."""
    c = F.replace(unescape(c), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, "[ \t]+", " "))


def clip(c: Column, limit: int, marker: str = "...") -> Column:
    """Cut to ``limit`` characters, trim the cut end and append ``marker``."""

    def body(v: Column) -> Column:
        cut = rstrip(F.substring(v, 1, limit))
        return F.when(F.length(v) > limit, F.concat(cut, F.lit(marker)) if marker else cut).otherwise(v)

    return let(c, body)


def strip_html(c: Column, keep_lines: bool = False) -> Column:
    """Remove scripts, styles and tags."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, f"(?is)<{tag}.*?>.*?</{tag}>", " ")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    if keep_lines:
        return normalize(c)
    return squash(c)


def html_to_text(c: Column) -> Column:
    """Text of a fragment with one line per block element."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(?:p|div|article|section|h[1-6]|li|ul|ol|blockquote|pre|tr)\b[^>]*>", "\n")
    c = strip_html(c, keep_lines=True)  # normalizes; references are decoded once, so ``&amp;lt;`` is the text ``&lt;``
    return strip(F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), "\n{2,}", "\n"))


def _first_meta(body: Column, attribute: str, value: str) -> Column:
    pattern = f"(?is)<meta[^>]+{attribute}=[\"']{value}[\"'][^>]+content=[\"'](.*?)[\"']"
    return F.regexp_extract(body, pattern, 1)


def page_title(body: Column) -> Column:
    """Open-graph title, then card title, then ``<title>``; NULL when none has text."""
    found = [
        _first_meta(body, "property", "og:title"),
        _first_meta(body, "name", "twitter:title"),
        F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1),
    ]
    return F.coalesce(*[F.nullif(normalize(strip_html(c)), F.lit("")) for c in found])


def meta_description(body: Column) -> Column:
    found = [_first_meta(body, "name", "description"), _first_meta(body, "property", "og:description")]
    return F.coalesce(*[F.nullif(normalize(c), F.lit("")) for c in found])


def markdown_line(c: Column) -> Column:
    """Plain text of one Markdown line."""
    c = strip(c)
    for pattern, value in (
        (r"^#{1,6}\s*", ""),
        (r"^>\s*", ""),
        (r"^\d+\.\s+", ""),
        (r"!\[[^\]]*\]\([^)]+\)", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        ("`", ""),
    ):
        c = F.regexp_replace(c, pattern, value)
    return squash(strip(c, " -*\t"))


def normalize_command(c: Column) -> Column:
    """Command text up to the first CJK character, without closing punctuation."""
    value = strip(c)
    value = strip(F.regexp_replace(value, f"(?s){CJK}.*$", ""))
    return rstrip(value, "；;：:，。")


def clean_skill_name(c: Column) -> Column:
    c = strip(squash(c), "，。；;：:、- ")
    c = F.translate(c, "「」", "")
    return clip(c, 40, marker="")


def refine_title(title: Column, fallback: Column | None = None, default: str = "未命名内容") -> Column:
    """Drop site prefixes and suffixes, undo ``X - X`` and cap at 80 characters."""
    c = squash(text_or_empty(title))
    if fallback is not None:
        c = let(c, lambda v: F.when(v == "", squash(text_or_empty(fallback))).otherwise(v))
    c = strip(F.regexp_replace(c, r"^(?:GitHub|github)\s*-\s*", ""))
    c = strip(F.regexp_replace(c, r"(?iu)[_\-\s]*哔哩哔哩[_\-\s]*bilibili$", ""))
    c = strip(F.regexp_replace(c, r"(?iu)\s*[-|]\s*哔哩哔哩.*$", ""))
    c = strip(F.regexp_replace(c, r"^(.+?)\s*-\s*\1$", "$1"))
    return let(clip(c, 80, marker=""), lambda v: F.when(v == "", F.lit(default)).otherwise(v))


def media_title(title: Column) -> Column:
    """Title of a media page without the site name."""
    c = normalize(text_or_empty(title))
    c = strip(F.regexp_replace(c, r"(?iu)[\s_\-|]*(?:哔哩哔哩|bilibili).*$", ""), " -_|")
    return c


def topic_of_title(title: Column) -> Column:
    c = squash(text_or_empty(title))
    c = strip(F.regexp_replace(c, r"(?iu)[_\-\s]*哔哩哔哩[_\-\s]*bilibili$", ""), " -_|")
    c = strip(F.regexp_replace(c, "【[^】]{0,24}】", ""))
    c = strip(F.regexp_replace(c, r"\[[^\]]{0,24}\]", ""))
    return let(clip(c, 30, marker=""), lambda v: F.when(v == "", F.lit("该视频")).otherwise(v))


def normalize_bullet(c: Column) -> Column:
    """Trim closing punctuation; 120 characters, or 220 when a URL is inside."""

    def body(v: Column) -> Column:
        has_url = contains_any(v, ("http://", "https://"))
        return F.when(has_url, clip(v, 220)).otherwise(clip(v, 120))

    return let(strip(squash(c), "。；;"), body)


def strip_timestamp(c: Column) -> Column:
    return F.regexp_replace(squash(c), TIMESTAMP_PREFIX + r"\s*", "")


def strip_fact_label(c: Column) -> Column:
    """Remove a leading clock and a leading ``label:`` of at most 8 characters."""
    c = F.regexp_replace(strip(c), r"^\[[0-9:]+\]\s*", "")

    def cut(text: Column, sep: str) -> Column:
        label = F.substring_index(text, sep, 1)
        rest = F.substring(text, F.length(label) + 2, F.length(text))
        return F.when(F.length(strip(label)) <= 8, strip(rest)).otherwise(text)

    return let(
        c,
        lambda v: F.when(F.contains(v, F.lit(":")), cut(v, ":"))
        .when(F.contains(v, F.lit("：")), cut(v, "："))
        .otherwise(v),
    )


def first_sentence(c: Column) -> Column:
    """Text before the first sentence end, or the text itself."""
    # A function given whole would take the position as its second argument, the characters to strip.
    parts = F.filter(F.transform(F.split(squash(c), r"[。！？!?]"), lambda p: strip(p)), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), strip(c))


def safe_name(c: Column) -> Column:
    """File-system safe name of at most 120 characters."""
    c = F.substring(strip(F.regexp_replace(c, r'[\\/:*?"<>|]+', "-")), 1, 120)
    return let(c, lambda v: F.when(v == "", F.lit("untitled")).otherwise(v))


def slugify(c: Column) -> Column:
    """Lower-case slug that keeps CJK, at most 48 characters."""
    c = F.regexp_replace(F.lower(strip(c)), "[^0-9a-z\\u4e00-\\u9fff]+", "-")
    c = F.substring(strip(c, "-"), 1, 48)
    return let(c, lambda v: F.when(v == "", F.lit("case")).otherwise(v))


def choose(c: Column, allowed: Iterable[str], fallback: Column | str) -> Column:
    """Lower-cased value when it is one of ``allowed``, else ``fallback``."""
    value = F.lower(strip(text_or_empty(c)))
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(value.isin(*allowed), value).otherwise(other)


def token(c: Column) -> Column:
    """Comparison key: collapsed and lower-cased."""
    return F.lower(squash(text_or_empty(c)))


def percent_encode(c: Column, space: str = "%20", keep_slash: bool = False) -> Column:
    """RFC 3986 percent encoding of a path or query piece."""
    c = F.url_encode(c)
    c = F.replace(F.replace(c, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    if space != "+":
        c = F.replace(c, F.lit("+"), F.lit(space))
    if keep_slash:
        c = F.replace(c, F.lit("%2F"), F.lit("/"))
    return c
