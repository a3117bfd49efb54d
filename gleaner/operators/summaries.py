"""Rule summaries, summary validation and digest fields."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import lines as ln
from gleaner.operators import media
from gleaner.operators import predicates as pr
from gleaner.operators import profiles, quality, steps
from gleaner.operators.keyed import keep_where
from gleaner.operators.lines import first_by_key

#: Lines a rule summary never quotes, and its sentences.
FOOTER_TOKENS = ("行吟信息科技", "地址：", "电话：", "备案号", "违法和不良信息举报")
SKIPPED_LABELS = ("链接: ", "技能名: ", "命令: ")
NO_BULLETS, NO_QUOTES = "未能从证据中抽取到可用要点。", "无可用摘录。"
GENERIC_CONCLUSIONS = ("已提取核心事实。", "已提取核心事实")
DONE_WORDS = ("提取完成。", "提取完成", "完成。", "完成")


def _labelled(label: str, values: Column, n: int) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(ar.take(values, n), " | ")))


def plain_bullets(text: Column, url: Column, room: Column | int = 5) -> Column:
    """First lines of 8-120 characters that are content."""
    source = tx.strip(tx.text_or_empty(url))

    def keep(x: Column) -> Column:
        return (
            F.length(x).between(8, 120)
            & (x != source)
            & ~x.rlike(r"(?U)^https?://\S+$")
            & ~tx.contains_any(x, FOOTER_TOKENS)
            & ~(x.rlike("[？?]$") & (F.length(x) <= 36))
            & ~tx.starts_any(x, ("你这个", "我是", "我想问", "请问", "[提取到的关键信号]", *SKIPPED_LABELS))
            & ~(F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")))
        )

    return ar.take(F.filter(ar.lines(text), keep), room)


def plain_quotes(text: Column, url: Column, limit: int = 3) -> Column:
    """First distinct short lines fit for quoting."""
    source = tx.strip(tx.text_or_empty(url))

    def keep(x: Column) -> Column:
        return (
            F.length(x).between(8, 40)
            & (x != source)
            & ~x.rlike(r"(?U)^https?://\S+$")
            & ~tx.contains_any(x, FOOTER_TOKENS[:4])
            & ~x.rlike("[？?]$")
            & ~(F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")))
        )

    return ar.take(F.array_distinct(F.filter(ar.lines(text), keep)), limit)


def rule_summary(df: DataFrame) -> DataFrame:
    """Summarise evidence by rule. Adds the summary fields.

    Expects ``title, text, source_url, coverage, signals, step_items``. Signal
    bullets come first, then steps or up to five content lines in all.
    """
    s, source = F.col("signals"), tx.strip(tx.text_or_empty(F.col("source_url")))
    other_links = F.filter(s["links"], lambda u: u != source)
    heads = F.array_compact(
        F.array(
            _labelled("技能: ", s["skills"], 3),
            _labelled("技能ID: ", s["skill_ids"], 4),
            _labelled("命令: ", s["commands"], 3),
            _labelled("链接: ", other_links, 2),
            _labelled("项目: ", s["projects"], 3),
        )
    )
    step_text = F.transform(
        ar.take(F.col("step_items"), 7), lambda i: F.concat_ws("：", i["title"], F.nullif(i["detail"], F.lit("")))
    )
    df = df.withColumn("_heads", heads)
    room = F.greatest(F.lit(5) - F.size("_heads"), F.lit(1))
    body = F.when(F.size("step_items") > 0, step_text).otherwise(plain_bullets(F.col("text"), F.col("source_url"), room))
    df = df.withColumn("_bullets", F.concat(F.col("_heads"), F.coalesce(body, ar.empty_strings())))
    bullets = F.when(F.size("_bullets") > 0, F.col("_bullets")).otherwise(ar.strings(NO_BULLETS))
    found = F.array_compact(
        F.array(
            F.when(F.size(s["projects"]) > 0, F.concat(F.lit("识别到项目 "), F.get(s["projects"], F.lit(0)))),
            F.when(F.size(s["skill_ids"]) > 0, F.concat(F.lit("技能ID "), F.get(s["skill_ids"], F.lit(0)))),
            F.when(F.size(s["commands"]) > 0, F.lit("包含可执行命令")),
        )
    )

    def behind(sep: str, c: Column) -> Column:
        return F.when(F.contains(c, F.lit(sep)), tx.strip(F.substring(c, F.instr(c, sep) + 1, F.length(c)))).otherwise(c)

    lead = tx.strip(tx.squash(F.get(bullets, F.lit(0))), "。；;")
    lead = tx.let(tx.let(lead, lambda c: behind(":", c)), lambda c: behind("：", c))
    opening = tx.let(
        lead,
        lambda c: F.when(c != "", F.array(F.concat(F.lit("核心信息是："), c))).otherwise(
            ar.strings("已从证据中提取核心事实（规则摘要）")
        ),
    )
    parts = F.concat(
        F.when(F.size(found) > 0, found).otherwise(opening),
        F.when(F.col("coverage") == "partial", ar.strings("证据不完整")).otherwise(ar.empty_strings()),
    )
    quotes = tx.let(
        plain_quotes(F.col("text"), F.col("source_url")),
        lambda q: F.when(F.size(q) > 0, q).otherwise(ar.strings(NO_QUOTES)),
    )
    return df.withColumns(
        {
            "summary_title": tx.refine_title(F.col("title")),
            "bullets": bullets,
            "conclusion": F.concat(F.array_join(parts, "，"), F.lit("。")),
            "quotes": quotes,
            "primary_topic": F.lit(lx.UNCATEGORISED),
            "confidence": F.lit("medium"),
        }
    ).drop("_heads", "_bullets")


def rank_projects(projects: Column, links: Column, text: Column) -> Column:
    """Projects by explicit mention (+2), canonical link (+1) and raw-only link (-1)."""
    low = F.lower(tx.text_or_empty(text))
    low_links = F.transform(links, lambda u: F.lower(u))

    def score(p: Column) -> Column:
        home = F.lower(F.concat(F.lit("https://github.com/"), p))
        said = F.contains(F.replace(low, F.concat(home, F.lit("/raw/")), F.lit(" ")), home)
        raw = F.exists(low_links, lambda u: F.startswith(u, F.concat(home, F.lit("/raw/"))))
        return (
            F.when(said, F.lit(2)).otherwise(F.lit(0))
            + F.when(F.array_contains(low_links, home), F.lit(1)).otherwise(F.lit(0))
            - F.when(raw & ~said, F.lit(1)).otherwise(F.lit(0))
        )

    ranked = F.sort_array(F.transform(projects, lambda p, i: F.struct((-score(p)).alias("s"), i.alias("i"), p.alias("p"))))
    return F.transform(ranked, lambda e: e["p"])


def priority_bullets(signals: Column, text: Column, kind: Column, limit: int = 4) -> Column:
    """Labelled bullets of the strongest signals."""
    shown = F.transform(signals["links"], lambda u: urls.canonical_url(u, keep_case=True, http_only=True))

    def is_raw(u: Column) -> Column:
        return F.contains(F.lower(u), F.lit("/raw/")) | F.endswith(F.lower(u), F.lit(".skill"))

    def build(ordered: Column) -> Column:
        code = F.filter(ordered, lambda u: F.contains(F.lower(u), F.lit("github.com")))
        video = F.filter(
            ordered,
            lambda u: tx.contains_any(F.lower(u), ("youtube.com", "youtu.be", "bilibili.com", "vimeo.com"))
            & ~F.contains(F.lower(u), F.lit("github.com")),
        )
        other = F.filter(ordered, lambda u: ~F.array_contains(code, u) & ~F.array_contains(video, u))
        projects = F.when(
            (F.size(signals["projects"]) > 0) & (F.size(code) > 0), rank_projects(signals["projects"], ordered, text)
        ).otherwise(signals["projects"])
        installs = F.exists(signals["commands"], lambda c: F.contains(F.lower(c), F.lit("install")))
        not_video = kind != "video_url"
        rows = F.array_compact(
            F.array(
                _labelled("项目名称: ", projects, 1),
                _labelled("GitHub地址: ", code, 2),
                _labelled("视频链接: ", video, 2),
                _labelled("关键链接: ", other, 2),
                _labelled("技能名: ", signals["skills"], 2),
                _labelled("技能ID: ", signals["skill_ids"], 3),
                F.when(installs, _labelled("安装方法: ", signals["commands"], 2)).otherwise(
                    _labelled("关键命令: ", signals["commands"], 2)
                ),
                _labelled("前置条件: ", signals["prerequisites"], 2),
                _labelled("验证动作: ", signals["validation_actions"], 2),
                F.when(
                    not_video,
                    F.coalesce(_labelled("使用方式: ", signals["use_cases"], 2), _labelled("核心用途: ", signals["purposes"], 2)),
                ),
            )
        )
        return ar.keep_first(F.transform(rows, tx.normalize_bullet), limit)

    ordered = F.concat(F.filter(shown, lambda u: ~is_raw(u)), F.filter(shown, is_raw))
    return tx.let(ar.keep_first(ordered, 6), build)


def install_actions(signals: Column, text: Column, step_lines: Column, limit: int = 8) -> Column:
    """Commands, checks, steps and imperative lines as an action list."""
    commands = F.transform(signals["commands"], lambda c: F.concat(F.lit("执行命令："), tx.normalize_bullet(c)))
    checks = F.transform(
        F.transform(signals["validation_actions"], tx.normalize_bullet),
        lambda c: F.when(tx.starts_any(c, ("验证", "检查", "确认")), c).otherwise(F.concat(F.lit("验证动作："), c)),
    )
    lines = F.filter(
        F.transform(ar.lines(text), tx.normalize_bullet),
        lambda x: (F.length(x) <= 90)
        & ~tx.starts_any(x, ("http://", "https://"))
        & tx.contains_any(F.lower(x), ("安装", "执行", "运行", "配置", "验证", "启动", "/install-skill", ".skill")),
    )
    return ar.keep_first(F.concat(commands, checks, F.transform(step_lines, tx.normalize_bullet), lines), limit)


def fact_points(bullets: Column, title: Column, limit: int = 3) -> Column:
    """Short facts behind labels, without links, the title or platform counters."""
    labels = ("视频链接:", "关键链接:", "GitHub地址:", "项目名称:", "技能名:", "技能ID:")
    headings = ("标题 ", "标题:", "标题：", "标签:", "标签：", "UP主:", "UP主：", "播放量:", "点赞量:")
    openers = (
        "视频中介绍了", "视频介绍了", "视频详细解析了", "视频详细讲解了", "视频讲解了", "视频主要讲", "视频讲了", "视频指出",
        "视频强调了", "强调了", "作者强调了",
    )
    kept = F.filter(F.transform(bullets, tx.normalize_bullet), lambda b: ~tx.starts_any(b, labels))
    facts = F.transform(kept, lambda b: tx.normalize_bullet(tx.strip_fact_label(b)))
    facts = F.filter(
        facts,
        lambda f: (f != title)
        & ~tx.starts_any(f, ("http://", "https://", *headings))
        & ~tx.contains_any(f, ("播放量", "点赞量")),
    )
    cut = F.transform(facts, lambda f: tx.lstrip(F.regexp_replace(f, "^" + tx.alternation(openers), ""), "，,：: "))
    return ar.take(F.array_distinct(F.filter(cut, lambda f: F.length(f).between(8, 70))), limit)


class SummaryParts(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def normalize_summary(df: DataFrame) -> SummaryParts:
    """Normalise candidate summaries against their evidence and split off invalid ones.

    Expects evidence (``source_kind, source_url, text, title, coverage, signals,
    profile, gate_reasons, story_blocks, step_items, sections``) joined with a
    candidate (``s`` struct of the raw summary fields). Rejected rows keep a
    ``reject_reasons`` list instead of raising.
    """
    s = F.col("s")
    gated = F.size(ar.or_empty(F.col("gate_reasons"))) > 0
    df = df.withColumns(
        {
            "summary_title": tx.refine_title(s["title"], F.col("title")),
            "_outline": steps.outline_points(
                F.col("sections"), F.col("step_items"), [F.col("text")], media.story_points(F.col("story_blocks")), F.col("text")
            ),
            "_prior": priority_bullets(F.col("signals"), F.col("text"), F.col("source_kind")),
            "_cand": F.filter(
                F.transform(ar.or_empty(s["bullets"]), tx.normalize_bullet), lambda b: (b != "") & ~pr.is_generic(b)
            ),
        }
    )
    is_video = F.col("source_kind") == "video_url"
    numbered = F.transform("_outline", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p))
    merged = ar.keep_first(ln.dedupe_labels(F.concat(F.col("_prior"), F.col("_cand"))), 6)
    df = df.withColumn("_merged", merged)
    fallback = F.transform(
        ar.take(F.array_distinct(F.filter(F.transform(ar.lines(F.col("text")), tx.squash), lambda x: F.length(x).between(8, 120))), 7),
        tx.normalize_bullet,
    )
    padded = ar.keep_first(ln.dedupe_labels(F.concat(F.col("_merged"), fallback)), 6)
    bullets = (
        F.when(is_video & (F.size("_outline") > 0), numbered)
        .when(F.size("_merged") < 3, padded)
        .otherwise(F.col("_merged"))
    )
    df = df.withColumn("bullets", bullets)
    actions = ar.take(ar.keep_first(F.transform(ar.or_empty(s["follow_up_actions"]), tx.normalize_bullet)), 8)
    tutorial = pr.is_tutorial(
        F.col("profile"), F.col("text"), F.col("source_url"), F.size("step_items") > 0, F.size("signals.commands") > 0
    )
    df = df.withColumns(
        {
            "_acts": actions,
            "_install": install_actions(F.col("signals"), F.col("text"), F.transform("step_items", lambda i: i["title"])),
            "_facts": fact_points(F.col("bullets"), F.col("summary_title"), 3),
        }
    )
    practical = tx.let(
        ar.keep_first(F.concat(F.col("_install"), F.col("_acts")), 8),
        lambda a: ar.take(
            F.when(F.size(a) < 2, ar.keep_first(F.concat(a, ar.take(F.col("bullets"), 3)), 5)).otherwise(a), 6
        ),
    )
    guided = ar.keep_first(F.concat(ar.strings("补抓字幕或语音轨后再复核结论", "回到原视频确认完整上下文"), F.col("_acts")), 4)
    passive = ("观看视频", "回看视频", "打开原视频", "点开视频", "标题:", "标题：")
    own = ar.take(
        F.filter(
            "_acts",
            lambda a: ~tx.starts_any(a, passive)
            & ~a.rlike(r"^\[[0-9:]+\]")
            & ~tx.contains_any(a, ("获取详细步骤", "评论区"))
            & ~((F.col("summary_title") != lx.UNTITLED) & F.contains(a, F.col("summary_title"))),
        ),
        4,
    )
    conclusion = tx.squash(tx.text_or_empty(s["conclusion"]))
    facts, title = F.col("_facts"), F.col("summary_title")
    vague = pr.is_generic(conclusion) | conclusion.isin(*GENERIC_CONCLUSIONS, *DONE_WORDS) | (F.length(conclusion) < 12)
    about = (
        F.when(F.size(facts) >= 2, F.concat(F.lit("视频的核心意思是："), F.get(facts, F.lit(0)), F.lit("；同时补充"), F.get(facts, F.lit(1)), F.lit("。")))
        .when(F.size(facts) == 1, F.concat(F.lit("视频的核心意思是："), F.get(facts, F.lit(0)), F.lit("。")))
        .when(title != lx.UNTITLED, F.concat(F.lit("视频主要围绕《"), title, F.lit("》展开。")))
        .otherwise(conclusion)
    )
    known = F.array_compact(
        F.array(
            F.concat(F.lit("识别到项目 "), F.get(F.col("signals.projects"), F.lit(0))),
            F.concat(F.lit("技能为 "), F.get(F.col("signals.skills"), F.lit(0))),
            F.concat(F.lit("技能ID "), F.get(F.col("signals.skill_ids"), F.lit(0))),
            F.when(F.col("coverage") == "partial", F.lit("证据不完整")),
        )
    )
    listed = F.concat(F.array_join(F.when(F.size(known) > 0, known).otherwise(ar.strings("已提取核心事实")), "，"), F.lit("。"))
    generic = pr.is_generic(conclusion) | conclusion.isin(*GENERIC_CONCLUSIONS)
    refined = F.when(is_video & vague, about).when(generic, listed).otherwise(conclusion)
    quotes = ar.keep_first(s["evidence_quotes"], 5)
    confidence = tx.choose(s["confidence"], ("high", "medium", "low"), "medium")
    level = tx.choose(s["recommendation_level"], ("must_read", "recommended", "optional", "skip"), "optional")
    effect = tx.choose(s["effectiveness"], ("high", "medium", "low"), "medium")
    df = df.withColumns(
        {
            "actions": F.when(gated, guided).when(is_video, own).when(tutorial, practical).otherwise(ar.take(F.col("_acts"), 4)),
            "_conclusion": refined,
            "quotes": F.when(F.size(quotes) > 0, quotes).otherwise(ar.take(F.col("bullets"), 2)),
            "summary_coverage": F.when(gated, F.lit("partial")).otherwise(
                tx.choose(s["coverage"], ("full", "partial"), tx.choose(F.col("coverage"), ("full", "partial"), "partial"))
            ),
            "confidence": F.when(gated & (confidence == "high"), F.lit("medium")).otherwise(confidence),
            "recommendation_level": F.when(gated & (level == "must_read"), F.lit("optional")).otherwise(level),
            "effectiveness": F.when(gated & (effect == "high"), F.lit("medium")).otherwise(effect),
            "timeliness": tx.choose(s["timeliness"], ("high", "medium", "low"), "medium"),
            "primary_topic": F.coalesce(F.nullif(tx.strip(tx.text_or_empty(s["primary_topic"])), F.lit("")), F.lit(lx.UNCATEGORISED)),
            "secondary_topics": ar.keep_first(s["secondary_topics"], 6),
            "entities": ar.keep_first(s["entities"], 12),
            "note_tags": ar.keep_first(s["note_tags"], 8),
        }
    )
    noted = gated & ~F.contains(F.col("_conclusion"), F.lit("证据不完整"))
    df = df.withColumn(
        "conclusion",
        F.when(noted, F.concat(tx.rstrip(F.col("_conclusion"), "。"), F.lit("，当前证据不完整。"))).otherwise(F.col("_conclusion")),
    )
    # Requirements are looked up in everything the summary says, its source included.
    check = df.withColumns({"_given_title": F.col("title"), "title": F.concat_ws("\n", "summary_title", "source_url")})
    check = quality.signal_coverage(check, "_check").withColumn("title", F.col("_given_title")).drop("_given_title")
    reasons = F.concat(
        F.when(conclusion == "", ar.strings("missing conclusion")).otherwise(ar.empty_strings()),
        F.when(F.size("bullets") == 0, ar.strings("missing bullets")).otherwise(ar.empty_strings()),
        F.col("_check.missing"),
        F.when(
            is_video & (F.size("_outline") > 0) & (F.size("bullets") < F.size("_outline")),
            F.array(F.concat_ws("/", F.concat(F.lit("video_outline:"), F.size("bullets").cast("string")), F.size("_outline").cast("string"))),
        ).otherwise(ar.empty_strings()),
    )
    done = check.withColumn("reject_reasons", ar.take(reasons, 6))
    done = done.drop("_outline", "_prior", "_cand", "_merged", "_acts", "_install", "_facts", "_conclusion", "_check", "s")
    accepted = keep_where(done, F.size("reject_reasons") == 0).drop("reject_reasons")
    return SummaryParts(accepted, keep_where(done, F.size("reject_reasons") > 0))


def digest_fields(bullets: Column, conclusion: Column, k: int = 3, size_limit: int = 3500) -> Column:
    """struct(content, links, project, repo_url, lead, compact) for a short digest."""
    link_labels = ("关键链接:", "视频链接:", "GitHub地址:", "仓库地址:", "文档链接:")
    clean = ar.take(F.array_distinct(F.filter(F.transform(bullets, lambda b: tx.strip(tx.squash(b), "。；;")), lambda b: b != "")), 8)
    plain = F.filter(
        F.transform(clean, lambda b: tx.strip(F.regexp_replace(b, r"^\d+\.\s*", ""), "。；;")), lambda b: b != ""
    )

    def value(c: Column) -> Column:
        return tx.strip(F.substring(c, F.instr(c, ":") + 1, F.length(c)))

    def first(test) -> Column:
        return F.try_element_at(F.filter(clean, test), F.lit(1))

    links = F.transform(F.filter(plain, lambda b: tx.starts_any(b, link_labels)), value)
    project = first(lambda b: tx.starts_any(b, ("项目名称:", "项目仓库:", "项目:")))
    repo = first(
        lambda b: F.contains(b, F.lit("github.com/")) | tx.starts_any(b, ("GitHub地址:", "仓库地址:", "链接:"))
    )
    sentence = tx.first_sentence(tx.text_or_empty(conclusion))
    size = F.length(F.concat_ws("\n", conclusion, F.array_join(bullets, "\n")))
    return F.struct(
        ar.take(F.filter(plain, lambda b: ~tx.starts_any(b, link_labels)), k).alias("content"),
        ar.take(F.array_distinct(F.filter(links, lambda u: u != "")), 2).alias("links"),
        value(project).alias("project"),
        F.when(F.contains(repo, F.lit(":")), value(repo)).otherwise(repo).alias("repo_url"),
        F.when(sentence == "", F.lit("未提取到有效结论。")).otherwise(sentence).alias("lead"),
        (size > size_limit).alias("compact"),
    )


def summary_from_text(text: Column, base: Column) -> Column:
    """Summary struct from the plain output of an external tool, over a base summary."""
    cleaned = F.filter(ar.lines(text), lambda x: ~x.rlike(r"^\d+s · \$[\d.]+ · \d+ words"))
    trimmed = F.transform(
        cleaned, lambda x: tx.clip(tx.strip(tx.squash(F.regexp_replace(x, r"^[-*]\s+", "")), "。；;"), 180)
    )

    def build(xs: Column) -> Column:
        lead = F.get(xs, F.lit(0))
        long_enough = ar.take(F.filter(xs, lambda x: F.length(x) >= 6), 6)
        linked = ar.take(
            F.filter(xs, lambda x: tx.contains_any(F.lower(x), ("http://", "https://", "github.com"))), 3
        )
        empty = F.size(xs) == 0
        title_ok = (F.length(lead) <= 60) & ~F.endswith(lead, F.lit(":"))
        return F.struct(
            F.when(~empty & title_ok, lead).otherwise(base["title"]).alias("title"),
            F.when(empty, base["conclusion"]).otherwise(tx.clip(lead, 90)).alias("conclusion"),
            F.when(F.size(long_enough) > 0, long_enough).otherwise(base["bullets"]).alias("bullets"),
            F.when(F.size(linked) > 0, linked).otherwise(base["quotes"]).alias("quotes"),
        )

    return tx.let(first_by_key(trimmed, lambda x: F.lower(x)), build)


def document_summary(doc: Column) -> Column:
    """Summary struct of a structured document."""
    heads = F.transform(doc["sections"], lambda s: tx.strip(tx.text_or_empty(s["heading"])))
    topic = F.coalesce(F.nullif(F.try_element_at(heads, F.lit(1)), F.lit("")), doc["title"])

    def bullet(s: Column) -> Column:
        heading, body = tx.strip(tx.text_or_empty(s["heading"])), F.substring(tx.strip(s["content"]), 1, 160)
        return F.when(body == "", F.lit("")).when(heading == "", body).otherwise(F.concat(heading, F.lit(": "), body))

    bullets = F.filter(F.transform(ar.take(doc["sections"], 5), bullet), lambda b: b != "")
    only_summary = F.when(tx.text_or_empty(doc["summary"]) != "", F.array(F.substring(doc["summary"], 1, 160))).otherwise(
        ar.empty_strings()
    )
    return F.struct(
        doc["title"].alias("title"),
        topic.alias("primary_topic"),
        doc["summary"].alias("conclusion"),
        F.when(F.size(bullets) > 0, bullets).otherwise(only_summary).alias("bullets"),
        F.filter(
            F.transform(ar.take(doc["sections"], 3), lambda s: F.substring(s["content"], 1, 80)), lambda q: tx.strip(q) != ""
        ).alias("quotes"),
        F.when(F.size(doc["sections"]) > 0, F.lit("full")).otherwise(F.lit("partial")).alias("coverage"),
    )


def extend_document(doc: Column, extra: Column) -> Column:
    """Document with a search section appended and the summary lengthened, without a model."""
    added = F.struct(
        F.lit("Search Enrichment").alias("heading"), F.lit(2).alias("level"), tx.strip(extra).alias("content")
    )
    summary = F.substring(tx.strip(F.concat_ws(" ", doc["summary"], F.substring(tx.strip(extra), 1, 200))), 1, 400)
    has_extra = tx.strip(tx.text_or_empty(extra)) != ""
    return F.struct(
        doc["title"].alias("title"),
        F.when(has_extra, summary).otherwise(doc["summary"]).alias("summary"),
        F.when(has_extra, F.concat(doc["sections"], F.array(added))).otherwise(doc["sections"]).alias("sections"),
        *[doc[n].alias(n) for n in ("images", "videos", "tables")],
    )


def compact_lines(text: Column, url: Column, noise: Iterable[str] = ("notifications", "issues", "pull requests", "license", "watchers"), limit: int = 4) -> Column:
    """Best evidence lines by label and link score, else the first meaningful lines."""
    noise = tuple(noise)
    labels = (
        "项目仓库:", "项目名称:", "仓库地址:", "GitHub地址:", "技能名:", "技能ID:", "命令:", "关键命令:", "安装方法:", "前置条件:",
        "验证动作:", "使用方式:", "核心用途:",
    )
    usage = ("安装", "使用", "用法", "自动激活", "读取", "输出", "决策", "分析")
    source = tx.strip(tx.text_or_empty(url))

    def score(x: Column) -> Column:
        low = F.lower(x)
        return (
            F.when(tx.starts_any(x, labels), F.lit(8)).otherwise(F.lit(0))
            + F.when(F.contains(low, F.lit("github.com/")) | tx.starts_any(x, ("http://", "https://")), F.lit(7)).otherwise(F.lit(0))
            + F.when(F.contains(low, F.lit("/install-skill")) | F.startswith(x, F.lit("命令：")), F.lit(7)).otherwise(F.lit(0))
            + F.when(tx.has_slug(x), F.lit(4)).otherwise(F.lit(0))
            + F.when(tx.contains_any(x, usage), F.lit(3)).otherwise(F.lit(0))
        )

    def keep(x: Column) -> Column:
        low = F.lower(x)
        return (
            (x != source)
            & ~x.rlike(r"^https?://\S+$")
            & ~tx.starts_any(x, ("编辑于", "发布于", "更新于"))
            & ~F.contains(F.replace(low, F.lit(" "), F.lit("")), F.lit("token消耗"))
            & ~(F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")))
            & (F.length(x) >= 8)
            & ~tx.contains_any(low, noise)
        )

    def pick(xs: Column) -> Column:
        scored = F.filter(
            ar.ranked(F.filter(xs, keep), score), lambda e: (e["rank"] < 0) | (F.length(e["value"]) >= 20)
        )
        ordered = F.transform(F.sort_array(scored), lambda e: e["value"])
        best = first_by_key(ordered, lambda x: tx.strip(F.regexp_replace(F.lower(x), "[.。…]+$", "")))
        shown = F.transform(ar.take(best, limit), lambda x: tx.clip(x, 140))
        meaningful = F.filter(
            F.transform(xs, tx.squash),
            lambda x: F.length(x).between(12, 140)
            & ~(F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")))
            & ~x.rlike(r"^https?://\S+$")
            & ~tx.contains_any(x, ("相关推荐", "点赞", "收藏", "评论", "登录", "注册")),
        )
        return F.when(F.size(shown) > 0, shown).otherwise(ar.take(meaningful, 3))

    return tx.let(first_by_key(ar.lines(text), tx.token), pick)


def summary_requirements(df: DataFrame) -> DataFrame:
    """(doc, key, value) rows of what summaries of these items have to mention."""
    values = profiles.required_values(F.col("profile"), F.col("signals"))
    return ar.explode_rows(df, df.columns, values, "requirement").drop("ord")
