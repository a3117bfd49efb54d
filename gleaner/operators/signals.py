"""Signal extraction: twelve kinds of values per text, without a shuffle.

Signals are produced as one struct of string arrays per document. ``long_form``
turns it into rows (doc, kind, ord, value).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import predicates as pr

URL_PATTERN = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
URL_TAIL = ")]}>,.;，。；："
REPO_URL = r"(?i)(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9_.\-]{1,39})/([A-Za-z0-9_.\-]{1,100})"
REPO_LINE = r"(?U)\b([A-Za-z0-9_.\-]{1,39})\s*/\s*([A-Za-z0-9_.\-]{2,100})\b"


@dataclass(frozen=True)
class SignalLexicon:
    high_value_domains: tuple[str, ...] = lx.HIGH_VALUE_DOMAINS
    low_value_domains: tuple[str, ...] = lx.LOW_VALUE_DOMAINS
    forced_source: tuple[str, ...] = lx.FORCED_SOURCE_LINKS
    slug_stop: tuple[str, ...] = lx.SLUG_STOPLIST
    keyword_lines: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(lx.KEYWORD_LINES))
    prerequisite_starts: tuple[str, ...] = lx.PREREQUISITE_STARTS
    products: tuple[str, ...] = ()


DEFAULT = SignalLexicon()


def _values(arr: Column) -> Column:
    """Distinct non-empty values in order."""
    return F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != "")))


def _repo_pairs(hits: Column, pattern: str) -> Column:
    pairs = F.transform(
        hits,
        lambda h: F.struct(
            tx.strip(F.regexp_extract(h, pattern, 1), ".-_/").alias("owner"),
            tx.strip(F.regexp_extract(h, pattern, 2), ".-_/").alias("repo"),
        ),
    )
    valid = F.filter(pairs, lambda p: pr.is_repo(p["owner"], p["repo"]))
    return F.transform(valid, lambda p: F.concat(p["owner"], F.lit("/"), p["repo"]))


def links(text: Column, source: Column, lexicon: SignalLexicon = DEFAULT) -> Column:
    """High-value links of a text, trimmed and canonical."""
    found = F.regexp_extract_all(text, F.lit(URL_PATTERN), 0)
    cleaned = F.transform(found, lambda u: urls.canonical_url(tx.rstrip(u, URL_TAIL), http_only=True))
    return F.filter(
        cleaned,
        lambda u: pr.is_high_value_link(u, source, lexicon.high_value_domains, lexicon.low_value_domains),
    )


def source_link(source: Column, lexicon: SignalLexicon = DEFAULT) -> Column:
    """The source itself when it is a video page or a high-value link, else empty."""
    canonical = urls.canonical_url(source, http_only=True)
    wanted = tx.contains_any(F.lower(tx.text_or_empty(source)), lexicon.forced_source) | pr.is_high_value_link(
        canonical, source, lexicon.high_value_domains, lexicon.low_value_domains
    )
    return F.when((tx.text_or_empty(source) != "") & wanted, F.array(canonical)).otherwise(ar.empty_strings())


def projects(text: Column, lines: Column, source: Column) -> Column:
    """Repositories from URLs, then from ``owner / repo`` lines with repository context."""
    # Cheap substring tests run before the patterns.
    hits = F.when(
        F.contains(F.lower(text), F.lit("github.com/")), F.regexp_extract_all(text, F.lit(REPO_URL), 0)
    ).otherwise(ar.empty_strings())
    by_url = _repo_pairs(hits, REPO_URL)
    context = F.filter(
        lines,
        lambda x: F.contains(x, F.lit("/")) & tx.contains_any(F.lower(x), lx.REPO_CONTEXT_TOKENS) & x.rlike(REPO_LINE),
    )
    by_line = _repo_pairs(context, REPO_LINE)
    on_host = F.contains(F.lower(tx.text_or_empty(source)), F.lit("github.com/"))
    return _values(F.when(on_host, by_url).otherwise(F.concat(by_url, by_line)))


def skills(text: Column, lexicon: SignalLexicon = DEFAULT, limit: int = 6) -> Column:
    def named(pattern: str, suffix: bool) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 1)
        names = F.transform(found, lambda m: tx.clean_skill_name(F.concat(m, F.lit(" Skill")) if suffix else m))
        return F.filter(names, lambda n: ~pr.is_noisy_skill(n, lexicon.products))

    quoted = _values(
        F.concat(
            named(r"(?iu)「([^」]{2,60})」(?U)\s*Skill", True),
            named(r"(?iu)「([^」]{2,80}Skill)」", False),
        )
    )
    plain = F.filter(
        named(r"(?iuU)([A-Za-z0-9\x{4e00}-\x{9fff}\-]{2,40})\s*Skill", True),
        lambda n: ~tx.contains_any(n, ("http", "/", ".", ":", *lx.SKILL_NAME_STOP)),
    )
    found = tx.let(
        quoted,
        lambda q: F.when(F.size(q) >= limit, _values(F.concat(q, ar.take(plain, 1)))).otherwise(
            ar.take(_values(F.concat(q, plain)), limit)
        ),
    )
    return F.when(F.contains(F.lower(text), F.lit("skill")), found).otherwise(ar.empty_strings())


def commands(lines: Column, lexicon: SignalLexicon = DEFAULT, limit: int = 6) -> Column:
    label = "命令："
    found = F.transform(
        lines,
        lambda x: F.when(
            F.startswith(x, F.lit(label)), tx.normalize_command(F.substring(x, len(label) + 1, F.length(x)))
        ).when(pr.is_command(x, products=lexicon.products), tx.normalize_command(x)),
    )
    return ar.take(_values(found), limit)


def skill_ids(lines: Column, lexicon: SignalLexicon = DEFAULT, limit: int = 6) -> Column:
    def context_of(x: Column) -> Column:
        return tx.contains_any(F.lower(x), ("skill id", "技能id", ".skill", "/install-skill"))

    def of_line(x: Column) -> Column:
        low, context = F.lower(x), context_of(x)
        slugs = F.regexp_extract_all(x, F.lit(tx.SLUG), 0)
        return F.filter(
            slugs,
            lambda s: ~F.startswith(s, F.lit("http")) & ~s.isin(*lexicon.slug_stop) & (context | (low == s)),
        )

    with_slug = F.filter(
        lines, lambda x: F.contains(x, F.lit("-")) & (~F.contains(x, F.lit(" ")) | context_of(x))
    )
    return ar.take(_values(F.flatten(F.transform(with_slug, of_line))), limit)


def hashtags(text: Column, limit: int = 10) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"#([A-Za-z0-9_\-\x{4e00}-\x{9fff}]{2,30})"), 1)
    return ar.take(_values(F.transform(found, lambda t: F.concat(F.lit("#"), t))), limit)


def keyword_line(kind: str, x: Column, lexicon: SignalLexicon = DEFAULT) -> Column:
    """Does line ``x`` belong to one of the six keyword kinds?"""
    low = F.lower(x)
    tokens = lexicon.keyword_lines.get(kind, ())
    if kind in ("boundaries", "common_errors"):
        hit = tx.contains_any(F.replace(low, F.lit(" "), F.lit("")), tokens)
    else:
        hit = tx.contains_any(low, tokens)
    if kind == "prerequisites":
        hit = hit | tx.starts_any(x, lexicon.prerequisite_starts)
    if kind == "purposes":
        hit = hit & ~pr.is_command(x, products=lexicon.products)
    return F.length(x).between(6, 220) & hit


def keyword_lines(kind: str, lines: Column, lexicon: SignalLexicon = DEFAULT, limit: int = 6) -> Column:
    return ar.take(F.array_distinct(F.filter(lines, lambda x: keyword_line(kind, x, lexicon))), limit)


def extract_signals(
    df: DataFrame,
    text: str = "text",
    source: str = "source_url",
    out: str = "signals",
    lexicon: SignalLexicon = DEFAULT,
) -> DataFrame:
    """Add ``out``: struct of the twelve signal arrays."""
    body, src = tx.text_or_empty(F.col(text)), F.col(source)
    df = df.withColumn("_lines", ar.lines(F.col(text)))
    line_col = F.col("_lines")
    df = df.withColumn("_projects", projects(body, line_col, src))
    repo_links = F.transform(F.col("_projects"), lambda p: F.concat(F.lit("https://github.com/"), p))
    arrays = {
        "skills": skills(body, lexicon),
        "projects": F.col("_projects"),
        "skill_ids": skill_ids(line_col, lexicon),
        "commands": commands(line_col, lexicon),
        "links": _values(F.concat(links(body, src, lexicon), repo_links, source_link(src, lexicon))),
        "hashtags": hashtags(body),
        **{kind: keyword_lines(kind, line_col, lexicon) for kind in lx.KEYWORD_LINES},
    }
    signals = F.struct(*[arrays[k].alias(k) for k in lx.SIGNAL_KINDS])
    return df.withColumn(out, signals).drop("_lines", "_projects")


def tighten_signals(signals: Column, source: Column) -> Column:
    """Signals of a repository page: its own project first and fewer values per kind."""
    repo = urls.repo_of(source)
    home = F.concat(F.lit("https://github.com/"), repo)
    on_host = F.startswith(F.lower(tx.text_or_empty(source)), F.lit("https://github.com/"))
    extra = F.filter(
        signals["links"],
        lambda u: F.startswith(F.lower(u), F.lit("https://github.com/"))
        & (F.contains(F.lower(u), F.lit("/raw/")) | F.endswith(F.lower(u), F.lit(".skill"))),
    )
    own = F.concat(F.array(home), F.when(on_host, F.array(source)).otherwise(ar.empty_strings()), extra)
    limits = {"skills": 3, "skill_ids": 4, "commands": 2, "hashtags": 6}
    fields = {
        "projects": F.when(repo.isNotNull(), F.array(repo)).otherwise(ar.keep_first(signals["projects"], 2)),
        "links": ar.keep_first(F.when(repo.isNotNull(), own).otherwise(signals["links"]), 3),
        **{k: ar.keep_first(signals[k], n) for k, n in limits.items()},
    }
    return F.struct(*[fields.get(k, ar.empty_strings()).alias(k) for k in lx.SIGNAL_KINDS])


def has_signals(signals: Column, kinds: Iterable[str] = ("skills", "skill_ids", "commands", "links")) -> Column:
    return tx.any_of(F.size(signals[k]) > 0 for k in kinds)


def long_form(df: DataFrame, doc_id: str, signals: str = "signals") -> DataFrame:
    """(doc_id, kind, ord, value) rows."""

    def tagged(kind: str) -> Column:
        return F.transform(
            F.col(signals)[kind], lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), v.alias("value"))
        )

    rows = ar.explode_rows(df, doc_id, F.concat(*[tagged(k) for k in lx.SIGNAL_KINDS]), "s", "n")
    return rows.select(doc_id, "s.kind", "s.ord", "s.value")
