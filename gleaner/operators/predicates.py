"""Line and row predicates as boolean Columns.

Vocabularies are arguments. ``products`` lets a caller add names of tools of its
own to the command rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.config import EngineConfig, GateConfig
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls


def route(kind: Column, url: Column, hint: Column, code_hosts: Iterable[str] = ("github.com",)) -> Column:
    """Which evidence branch a request takes."""
    on_code_host = (tx.text_or_empty(hint) == "github") | tx.contains_any(tx.text_or_empty(url), code_hosts)
    return (
        F.when(kind == "pasted_text", F.lit("text"))
        .when(kind == "image", F.lit("image"))
        .when(kind == "video_url", F.lit("video"))
        .when(on_code_host, F.lit("repository"))
        .when(kind.isin("url", "mixed"), F.lit("web"))
        .otherwise(F.lit("text"))
    )


def is_url_only(text: Column, url: Column) -> Column:
    given = tx.strip(tx.text_or_empty(url))
    return tx.let(
        tx.strip(tx.text_or_empty(text)),
        lambda v: (v != "") & ((v == given) | v.rlike(r"(?U)^https?://\S+$")),
    )


def is_legal_footer(c: Column, lexicon: Iterable[str] = lx.LEGAL_FOOTER_TOKENS, at_least: int = 3) -> Column:
    tokens = tuple(lexicon)
    enough = tx.count_contained(c, tokens) >= at_least
    return tx.contains_any(c, tokens) & enough


def is_ui_noise(
    c: Column,
    exact: Iterable[str] = lx.UI_NOISE_EXACT,
    filing: Iterable[str] = lx.UI_NOISE_FILING,
    footer: Iterable[str] = lx.LEGAL_FOOTER_TOKENS,
    author_suffix: str = "作者",
) -> Column:
    """Interface text: menu words, tags, counters, dates, addresses, filings."""

    def body(v: Column) -> Column:
        return (
            (v == "")
            | v.rlike(r"^(?:#|\d+(?:/\d+)?$|\d+天前|地址：.*[省市区路号弄座室]|电话：.*[0-9\-]{6,})")
            | tx.equals_any(v, exact)
            | F.endswith(v, F.lit(author_suffix))
            | tx.contains_any(v, filing)
            | is_legal_footer(v, footer)
        )

    return tx.let(tx.strip(tx.strip(c), '"'), body)


def is_step_noise(c: Column, lexicon: Iterable[str] = lx.STEP_NOISE_TOKENS) -> Column:
    return tx.contains_any(c, lexicon)


def is_comment_noise(
    c: Column,
    prefixes: Iterable[str] = lx.COMMENT_PREFIXES,
    tokens: Iterable[str] = lx.COMMENT_TOKENS,
    reactions: Iterable[str] = lx.COMMENT_REACTIONS,
) -> Column:

    def body(v: Column) -> Column:
        return (
            (tx.ends_any(v, ("?", "？")) & (F.length(v) <= 36))
            | tx.starts_any(v, prefixes)
            | tx.contains_any(v, tokens)
            | ((F.length(v) <= 24) & tx.contains_any(v, reactions))
        )

    return tx.let(tx.strip(c), body)


def is_line_noise(c: Column) -> Column:
    return is_ui_noise(c) | is_comment_noise(c)


def is_command(
    c: Column,
    tokens: Iterable[str] = lx.COMMAND_TOKENS,
    prefixes: Iterable[str] = lx.COMMAND_PREFIXES,
    pipe_tools: Iterable[str] = lx.COMMAND_PIPE_TOOLS,
    products: Iterable[str] = (),
) -> Column:
    """Shell-like line. Prose that merely mentions a tool is not one."""
    products = tuple(products)
    named = (*prefixes, *(p + " " for p in products))

    def body(v: Column, low: Column, prefixed: Column) -> Column:
        return _command_rule(v, low, prefixed, tokens, pipe_tools, products)

    return tx.let(
        tx.strip(c),
        lambda v: tx.let(F.lower(v), lambda low: tx.let(tx.starts_any(low, named), lambda p: body(v, low, p))),
    )


def _command_rule(
    v: Column, low: Column, prefixed: Column, tokens: Iterable[str], pipe_tools: Iterable[str], products: tuple[str, ...]
) -> Column:
    words = F.size(F.split(v, r"(?U)\s+"))
    piped = F.contains(v, F.lit("|"))
    excluded = (
        (v == "")
        | tx.starts_any(v, ("http://", "https://"))
        | v.rlike("<[^>]+>")
        | tx.starts_any(v, ("<img", "<strong", "<div", "<span", "<a "))
        | v.rlike(tx.CJK)
    )
    wordy_pipe = (words > 7) & piped & ~prefixed & ~tx.contains_any(v, ("--", " /", "\\", "=", ";"))
    wordy = (words > 5) & ~prefixed & ~tx.contains_any(v, ("--", "&&", "||", " /", "\\", "=", ";", "$"))
    prose = tx.starts_any(low, [f"{p} {w} " for p in products for w in ("is", "was", "can", "supports")])
    bare = tx.contains_any(low, products) & ~tx.contains_any(v, (" ", "-", "_", "/"))
    mentioned = tx.contains_any(low, (*tokens, *products))
    accepted = F.when(mentioned, ~prose & ~bare & (prefixed | (words <= 3))).otherwise(
        piped & tx.contains_any(low, pipe_tools)
    )
    # The cheap vocabulary test goes first; word counts are only needed behind it.
    return accepted & ~excluded & ~wordy_pipe & ~wordy


def is_high_value_link(
    url: Column,
    source: Column | None = None,
    allow: Iterable[str] = lx.HIGH_VALUE_DOMAINS,
    deny: Iterable[str] = lx.LOW_VALUE_DOMAINS,
) -> Column:
    low = F.lower(url)
    ok = tx.starts_any(low, ("http://", "https://")) & ~tx.contains_any(low, deny) & tx.contains_any(low, allow)
    if source is None:
        return ok
    source = tx.text_or_empty(source)
    same_site = tx.any_of(
        F.contains(source, F.lit(site)) & F.contains(low, F.lit(site)) for site in lx.SAME_SITE_EXCLUDED
    )
    return ok & ~same_site


def _time_fragment(c: Column) -> Column:
    return c.rlike(r"^(?:\d{1,2}|[0-5]?\d(?:s|m|min|sec)?)$")


def is_repo(owner: Column, repo: Column) -> Column:
    """Plausible ``owner/repo`` pair: letters on both sides, no clock, host or reserved word."""

    def name_ok(c: Column) -> Column:
        return c.rlike("[a-z]") & ~_time_fragment(c) & ~c.isin(*lx.REPO_RESERVED_WORDS)

    def owner_ok(o: Column) -> Column:
        return (
            name_ok(o)
            & ~o.isin("github", "github.com", "www.github.com")
            & ~F.startswith(o, F.lit("http"))
            & ~(F.contains(o, F.lit(".")) & tx.ends_any(o, lx.REPO_HOST_SUFFIXES))
        )

    return tx.let(F.lower(tx.strip(owner, ".-_/")), owner_ok) & tx.let(F.lower(tx.strip(repo, ".-_/")), name_ok)


def is_noisy_skill(c: Column, products: Iterable[str] = ()) -> Column:
    named = [f"{p} skill" for p in products]

    def body(low: Column) -> Column:
        return (
            (low == "")
            | low.isin("skill", *named)
            | tx.starts_any(low, ("install-", "install ", "github", "http", "day1global-"))
            | low.rlike(r"^[a-z0-9._-]+\s*skill$")
            | (F.contains(low, F.lit("install")) & ~tx.contains_any(low, ("analy", "分析")))
        )

    return tx.let(F.lower(tx.squash(tx.text_or_empty(c))), body)


def is_feedback(text: Column, author: Column, owner: Column) -> Column:
    """Substantial reader remark: not by the owner, not a question or a reaction."""

    def body(v: Column) -> Column:
        size = F.length(v)
        return (
            size.between(8, 90)
            & ~is_ui_noise(v)
            & ~tx.contains_any(v, lx.FEEDBACK_BANNED_TOKENS)
            & ~tx.ends_any(v, lx.FEEDBACK_QUESTION_ENDS)
            & ~tx.starts_any(v, lx.FEEDBACK_QUESTION_STARTS)
            & ~((size <= 18) & tx.contains_any(v, lx.FEEDBACK_REACTIONS))
        )

    by_owner = (
        (tx.text_or_empty(author) != "")
        & (tx.text_or_empty(owner) != "")
        & (tx.normalize(tx.text_or_empty(author)) == tx.normalize(tx.text_or_empty(owner)))
    )
    return ~by_owner & tx.let(tx.normalize(tx.text_or_empty(text)), body)


def evidence_gate(
    kind: Column,
    text: Column,
    url: Column,
    has_signal: Column,
    sources: Column,
    cfg: GateConfig = GateConfig(),
) -> Column:
    """Is there enough evidence text to summarise?"""
    v = tx.strip(tx.text_or_empty(text))
    size = F.length(v)
    pasted = (kind == "pasted_text") if cfg.allow_short_pasted_text else F.lit(False)
    return (
        F.when(v == "", F.lit(False))
        .when(pasted, F.lit(True))
        .when(is_url_only(v, url), F.lit(False))
        .when(tx.starts_any(F.lower(v), lx.ERROR_TEXT_PREFIXES), F.lit(False))
        .when(F.array_contains(ar.or_empty(sources), lx.BLOCKED_SOURCE), F.lit(True))
        .when(has_signal & (size >= cfg.min_chars_signal_rich), F.lit(True))
        .when(kind.isin("image", "video_url", "mixed") & (size >= cfg.min_chars_media), F.lit(True))
        .otherwise(size >= cfg.min_chars_general)
    )


def media_gate(kind: Column, text: Column, tracks: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """Reasons why media evidence is incomplete; empty when it is complete."""
    m = cfg.media

    def has(name: str) -> Column:
        return F.coalesce(tracks[name], F.lit(False))

    speech = has("has_subtitle") | has("has_transcript")
    visual = has("has_keyframes") | has("has_keyframe_ocr")
    applies = (kind == "video_url") & F.lit(m.enabled)
    reasons = F.array_compact(
        F.array(
            F.when(F.lit(m.require_speech_track) & ~speech, F.lit("missing speech track (subtitle/transcript)")),
            F.when(F.lit(m.require_visual_track) & ~visual, F.lit("missing visual track (keyframes/ocr)")),
            F.when(
                F.length(tx.strip(tx.text_or_empty(text))) < m.min_text_chars,
                F.lit(f"evidence text too short (<{m.min_text_chars} chars)"),
            ),
        )
    )
    return F.when(applies, reasons).otherwise(ar.empty_strings())


def needs_ocr(kind: Column, url: Column, text: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    o = cfg.ocr
    source = tx.text_or_empty(url)
    v = tx.strip(tx.text_or_empty(text))
    minimum = F.when(kind == "mixed", F.lit(o.min_chars_mixed)).otherwise(F.lit(o.min_chars_url))
    return (
        F.when((source == "") | tx.contains_any(F.lower(source), o.reliable_hosts), F.lit(False))
        .when(tx.contains_any(source, o.hosts), F.lit(True))
        .when((v == "") | is_url_only(v, url) | is_legal_footer(v), F.lit(True))
        .otherwise(F.length(v) < minimum)
    )


def filter_ocr_lines(
    raw: Column, strict: bool, limit: int = 25, signal_tokens: Iterable[str] = ("skill", "github")
) -> Column:
    """Array of OCR lines worth keeping. Strict mode asks for a technical signal."""
    trimmed = F.transform(
        ar.lines(raw),
        lambda x: tx.strip(F.regexp_replace(tx.normalize(x), r"(?U)^[^\w一-鿿#@:/.\-]+", "")),
    )

    def keep(v: Column) -> Column:
        return tx.let(F.lower(v), lambda low: keep_line(v, low))

    def keep_line(v: Column, low: Column) -> Column:
        slug = tx.has_slug(v)
        signal = tx.contains_any(low, signal_tokens) | F.startswith(v, F.lit("命令：")) | slug
        base = (
            (v != "")
            & ~is_ui_noise(v)
            & ~is_step_noise(v)
            & ~is_comment_noise(v)
            & ~v.rlike(r"^\d{1,2}:\d{2}$")
            & ~low.rlike(r"^\d+\s*(?:hours?|days?)\s+ago$")
        )
        if strict:
            return base & (signal | F.startswith(v, F.lit("#")))
        signal = signal | tx.contains_any(low, ("http://", "https://"))
        cjk = v.rlike(tx.CJK)
        digits = F.length(F.regexp_replace(v, r"(?U)\D", ""))
        return (
            base
            & ~tx.contains_any(low, lx.OCR_LOW_VALUE)
            & (cjk | signal)
            & ~((digits >= 4) & (F.length(v) <= 24) & ~signal)
            & ~(cjk & (F.length(v) < 6))
        )

    kept = F.transform(F.filter(trimmed, keep), lambda v: tx.clip(v, 220, marker=""))
    return ar.take(F.array_distinct(kept), limit)


def is_page_noise(c: Column, phrases: Iterable[str] = lx.PAGE_NOISE_PHRASES) -> Column:
    low = F.lower(tx.squash(tx.text_or_empty(c)))
    return (low == "") | tx.contains_any(low, phrases)


def is_decorative(src: Column, alt: Column) -> Column:
    return tx.contains_any(F.lower(src), lx.DECORATIVE_SRC) | F.lower(tx.strip(tx.text_or_empty(alt))).isin(
        *lx.DECORATIVE_ALT
    )


def is_candidate_url(
    c: Column, allow: Iterable[str] = lx.SAMPLING_DOMAINS, assets: Iterable[str] = lx.ASSET_TOKENS
) -> Column:
    low = F.lower(tx.text_or_empty(c))
    return (
        ~tx.contains_any(low, ("\n", "\r", " "))
        & tx.starts_any(low, ("http://", "https://"))
        & ~tx.contains_any(low, assets)
        & tx.contains_any(low, allow)
    )


def is_abs_url(c: Column) -> Column:
    v = tx.strip(tx.text_or_empty(c))
    return v.rlike(r"(?i)^https?://[^/?#\s]+")


def is_image_path(c: Column) -> Column:
    return tx.strip(tx.strip(c), "\"'").rlike(r"(?i)\.(?:png|jpg|jpeg|webp|bmp|gif)$")


def is_direct_video(c: Column) -> Column:
    return F.lower(urls.path(c)).rlike(r"\.(?:mp4|mov|m4v|mkv|webm)$")


def is_generic(c: Column, lexicon: Iterable[str] = lx.GENERIC_BULLET_TOKENS) -> Column:
    return tx.contains_any(F.lower(c), lexicon)


def is_topic(c: Column, blocklist: Iterable[str] = (), max_chars: int = 16) -> Column:
    """Topic names are short words without punctuation or long numbers."""
    v = tx.strip(c)
    return (
        F.length(v).between(2, max_chars)
        & ~tx.contains_any(F.lower(v), [b.lower() for b in blocklist])
        & ~v.rlike(r"[0-9]{3,}")
        & ~v.rlike(r"[/\\\[\]《》():]")
    )


def is_secondary_topic(c: Column, blocklist: Iterable[str] = ()) -> Column:
    return is_topic(c, blocklist, max_chars=10) & (F.length(c) <= 10)


def is_tutorial(
    profile: Column, text: Column, url: Column, has_steps: Column, has_commands: Column,
    tokens: Iterable[str] = lx.TUTORIAL_TOKENS,
) -> Column:
    return (
        profile.isin(*lx.PROFILES_WITH_CHECKLIST)
        | tx.contains_any(F.lower(tx.text_or_empty(text)), tokens)
        | F.contains(F.lower(tx.text_or_empty(url)), F.lit("cloud.tencent.com/developer/article"))
        | has_steps
        | has_commands
    )


def is_install(
    *texts: Column, tokens: Iterable[str] = ("安装", "部署", "onboard", "gateway", "/install-skill", "配对")
) -> Column:
    """Any of the given texts talks about installing or deploying."""
    return tx.contains_any(F.lower(F.concat_ws("\n", *texts)), tokens)


def is_video(
    kind: Column, url: Column,
    tokens: Iterable[str] = ("bilibili.com", "youtu.be", "youtube.com", "xiaohongshu.com/explore"),
) -> Column:
    return (kind == "video_url") | tx.contains_any(F.lower(tx.text_or_empty(url)), tokens)


def keep_checklist(profile: Column, actions: Column, tokens: Iterable[str] = lx.CHECKLIST_ACTION_TOKENS) -> Column:
    corpus = F.lower(F.array_join(ar.or_empty(actions), "\n"))
    return profile.isin(*lx.PROFILES_WITH_CHECKLIST) | tx.contains_any(corpus, tokens)


def is_raw_bullet(bullet: Column, transcript: Column, numbered: bool = True) -> Column:
    """A bullet that is just a stretch of transcript; what stands before a ``. `` in the first four characters
    doesn't count as long as bullets may be ``numbered``."""
    corpus = tx.drop_space(F.lower(tx.text_or_empty(transcript)))

    def body(point: Column) -> Column:
        verbatim = tx.let(tx.drop_space(point), lambda c: (F.length(c) >= 32) & F.contains(corpus, c))
        return (F.length(point) >= 90) | (~point.rlike("[，。；：:,]") & verbatim)

    return tx.let(normalize_point(bullet) if numbered else F.lower(tx.strip(bullet)), body)


def normalize_point(c: Column) -> Column:
    """Lower-case text without a short leading ``n. ``."""

    def body(v: Column) -> Column:
        numbered = F.contains(F.substring(v, 1, 4), F.lit(". "))
        return F.when(numbered, F.substring(v, F.instr(v, ". ") + 2, F.length(v))).otherwise(v)

    return tx.let(F.lower(tx.strip(c)), body)


def normalize_reason(c: Column) -> Column:
    """Part before the first colon, at most 80 characters, ``unknown`` when empty."""
    return tx.let(
        tx.squash(tx.text_or_empty(c)),
        lambda v: F.when(v == "", F.lit("unknown")).otherwise(
            F.substring(tx.strip(F.substring_index(v, ":", 1)), 1, 80)
        ),
    )


def auto_case_reason(
    kind: Column, dry_run: Column, reason: Column, warnings: Column, coverage: Column, quality: Column,
    threshold: float = 0.72,
) -> Column:
    """Why a finished item becomes a test case; NULL when it does not."""
    eligible = kind.isin("url", "video_url") & ~F.coalesce(dry_run, F.lit(False))
    warned = F.try_element_at(ar.keep_first(warnings), F.lit(1))
    return F.when(
        eligible,
        F.coalesce(
            F.when(tx.text_or_empty(reason) != "", F.nullif(normalize_reason(reason), F.lit(""))),
            F.when(warned.isNotNull(), F.nullif(normalize_reason(warned), F.lit(""))),
            F.when(coverage == "partial", F.lit("coverage_partial")),
            F.when(quality < threshold, F.lit("summary_quality_low")),
        ),
    )


def cache_eligible(url: Column, kind: Column, gate_reasons: Column, dry_run: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    dry = F.coalesce(dry_run, F.lit(False))
    allowed = F.when(dry, F.lit(cfg.cache.for_dry_run)).otherwise(F.lit(cfg.cache.for_live_run))
    incomplete = (kind == "video_url") & (F.size(ar.or_empty(gate_reasons)) > 0)
    return F.lit(cfg.cache.enabled) & (tx.text_or_empty(url) != "") & ~incomplete & allowed


def probe_class(
    title: Column, kind: Column, text: Column, has_track: Column, sources: Column, has_document: Column, has_signal: Column
) -> Column:
    """successful / partial_but_usable / blocked."""
    size = F.length(tx.strip(tx.text_or_empty(text)))
    missing = tx.contains_any(tx.strip(tx.text_or_empty(title)), ("页面未找到", "页面不见了", "无法浏览", "404"))
    usable = F.lit("partial_but_usable")
    media = (
        F.when(has_track & (size >= 120), F.lit("successful"))
        .when(has_track | (size >= 100) | (F.size(ar.or_empty(sources)) > 1), usable)
        .otherwise(F.lit("blocked"))
    )
    page = (
        F.when(has_document | has_signal | (size >= 160), F.lit("successful"))
        .when(size >= 90, usable)
        .otherwise(F.lit("blocked"))
    )
    return F.when(missing, F.lit("blocked")).when(kind == "video_url", media).otherwise(page)


def attempt_ok(status: Column, note: Column, notified: Column) -> Column:
    return (status == "done") & F.coalesce(note, F.lit(False)) & F.coalesce(notified, F.lit(False))


def strip_debug(c: Column, tokens: Iterable[str] = lx.DEBUG_TOKENS) -> Column:
    """Drop lines that leak tool output; keep blank lines inside the text."""
    raw = F.split(tx.text_or_empty(c), tx.LINE_BREAK)
    kept = F.filter(raw, lambda x: ~tx.contains_any(F.lower(x), tokens))
    return tx.strip(F.array_join(F.transform(kept, lambda x: tx.rstrip(x)), "\n"))


def split_guidance(
    text: Column, kind: Column, url: Column,
    tokens: Iterable[str] = lx.GUIDANCE_TOKENS, latin: Iterable[str] = lx.GUIDANCE_TOKENS_LATIN,
) -> Column:
    """struct(evidence, guidance): short imperative text beside a URL is guidance."""
    v = tx.strip(tx.text_or_empty(text))
    compact = tx.squash(v)
    with_url = kind.isin("video_url", "url", "mixed") & (tx.text_or_empty(url) != "")
    size = F.length(compact)
    guides = ((size <= 120) & tx.contains_any(compact, tokens)) | (
        (size <= 90) & tx.contains_any(F.lower(compact), latin)
    )
    none = F.lit("")
    return F.struct(
        F.when(~with_url, v).when(guides, none).otherwise(compact).alias("evidence"),
        F.when(with_url & guides, compact).otherwise(none).alias("guidance"),
    )


def entry_context(chat_id: Column, reply_to: Column, hint: Column, kind: Column, url: Column, text: Column, images: Column) -> Column:
    group = F.startswith(tx.strip(tx.text_or_empty(chat_id)), F.lit("-"))
    return F.struct(
        F.when(group, F.lit("group_chat")).otherwise(F.lit("direct_chat")).alias("chat_target"),
        reply_to.alias("reply_to_message_id"),
        tx.text_or_empty(hint).alias("platform_hint"),
        kind.alias("source_kind"),
        (tx.text_or_empty(url) != "").alias("has_source_url"),
        (tx.strip(tx.text_or_empty(text)) != "").alias("has_raw_text"),
        F.size(ar.or_empty(images)).alias("image_count"),
    )


def blocked_notice(url: Column, title: Column, warnings: Column) -> Column:
    """``page_gone`` / ``access_restricted`` for the site that blocks readers, else NULL."""
    on_site = F.contains(F.lower(tx.text_or_empty(url)), F.lit("xiaohongshu.com"))
    shown = tx.text_or_empty(title)
    warned = F.lower(F.array_join(ar.or_empty(warnings), " "))
    gone = tx.contains_any(shown, ("页面不见了", "无法浏览"))
    restricted = F.contains(shown, F.lit("安全限制")) | tx.contains_any(warned, ("ip存在风险", "安全限制"))
    return F.when(on_site, F.when(gone, F.lit("page_gone")).when(restricted, F.lit("access_restricted")))


def document_issues(doc: Column, extracted: Column) -> Column:
    """Quality codes of a structured document against the page it came from."""

    def compare_key(c: Column) -> Column:
        return F.lower(tx.drop_space(tx.text_or_empty(c)))

    def longest_body(sections: Column) -> Column:
        sizes = F.transform(sections, lambda s: F.length(tx.strip(tx.text_or_empty(s["content"]))))
        return F.coalesce(F.array_max(sizes), F.lit(0))

    main_size = F.length(tx.strip(tx.text_or_empty(extracted["main_text"])))
    body = longest_body(doc["sections"])
    summary = tx.text_or_empty(doc["summary"])
    mismatch = {
        name: (F.size(extracted[name]) > 0) & (F.size(extracted[name]) != F.size(doc[name]))
        for name in ("tables", "videos")
    }
    return F.array_compact(
        F.array(
            F.when(tx.strip(tx.text_or_empty(doc["title"])) == "", F.lit("missing_title")),
            F.when(tx.strip(summary) == "", F.lit("missing_summary")),
            F.when((summary != "") & (compare_key(summary) == compare_key(doc["title"])), F.lit("summary_repeats_title")),
            F.when((main_size > 0) & (body == 0), F.lit("missing_section_content")),
            F.when((main_size >= 200) & (F.size(doc["sections"]) > 0) & (body < 20), F.lit("sections_too_thin")),
            F.when(mismatch["tables"], F.lit("table_shape_mismatch")),
            F.when(mismatch["videos"], F.lit("video_shape_mismatch")),
        )
    )


#: Warning codes by how the warning text starts or what it holds.
WARNING_STARTS = (
    ("video_audio_failed", "未能拿到音频轨。"),
    ("video_keyframes_failed", "未能拿到视频关键帧。"),
    ("video_page_snapshot_failed", "未能拿到页面补充文本。"),
    ("video_html_fallback_failed", "页面兜底文本也没有成功拿到。"),
    ("video_subtitle_failed", "未能拿到字幕轨。"),
    ("browser_snapshot_failed", "浏览器快照抓取失败。"),
)
WARNING_CONTAINS = (
    (("unsupported url",), "当前分享链接形态不支持直接提取。"),
    (("no video formats found",), "当前没有拿到可用的视频流。"),
    (("当前笔记暂时无法浏览", "页面不见了"), "当前页面不可见，内容拿不到。"),
    (("request was rejected", "安全限制"), "平台侧有访问限制。"),
)


def summarize_warnings(warnings: Column, limit: int = 4) -> Column:
    """Distinct warning categories in order of first appearance."""

    def category(w: Column) -> Column:
        low = F.lower(w)
        by_start = [F.when(F.startswith(w, F.lit(k)), F.lit(v)) for k, v in WARNING_STARTS]
        by_text = [F.when(tx.contains_any(low, keys), F.lit(v)) for keys, v in WARNING_CONTAINS]
        return F.coalesce(*by_start, *by_text)

    mapped = F.transform(F.transform(ar.or_empty(warnings), lambda x: tx.strip(x)), category)
    return ar.take(F.array_distinct(F.array_compact(mapped)), limit)


def capture_status(kind: Column, title: Column, tracks: Column, warnings: Column) -> Column:
    """normal / video_partial / video_extract_blocked."""
    has_track = tx.any_of(
        F.coalesce(tracks[n], F.lit(False))
        for n in ("has_subtitle", "has_transcript", "has_keyframes", "has_keyframe_ocr")
    )
    warned = F.size(summarize_warnings(warnings)) > 0
    gone = tx.contains_any(tx.text_or_empty(title), ("页面不见了", "无法浏览"))
    return (
        F.when(kind != "video_url", F.lit("normal"))
        .when(~has_track & (gone | warned), F.lit("video_extract_blocked"))
        .when(has_track & warned, F.lit("video_partial"))
        .otherwise(F.lit("normal"))
    )
