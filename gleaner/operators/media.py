"""Media evidence: merge of text tracks and story blocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.config import EngineConfig
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import times as tm
from gleaner.operators import compaction as cp
from gleaner.operators import predicates as pr
from gleaner.operators import profiles, signals

# --- fixed values: story vocabularies and sentences ---------------------------------
GAME = ("攻略", "流派", "构筑", "打法", "卡组", "英雄", "boss", "角色")
TUTORIAL = ("教程", "安装", "部署", "配置", "工作流", "自动化", "接入", "运行")
WORKFLOW_LINES = (
    "自选股", "股票", "开盘", "买入", "持有", "分析", "推荐", "步骤", "部署", "配置", "运行", "构筑", "打法",
)
WORKFLOW_TUTORIAL = ("安装", "部署", "配置", "运行", "接入", "步骤", "命令")
WORKFLOW_GAME = ("构筑", "流派", "打法", "资源", "卡牌", "路线")
IMPLEMENTATION_LINES = (
    "github", "服务器", "部署", "自动化", "工作流", "数据", "信源", "模型", "行情", "业绩", "api", "分析方式", "专业",
)
IMPLEMENTATION_TOOLS = ("github", "服务器", "部署", "自动化", "工作流")
IMPLEMENTATION_DATA = ("行情", "业绩", "数据", "信源", "专业")
RISK_LINES = ("别真跟", "图一乐", "谨慎", "风险", "不要盲目", "参考", "娱乐", "回本", "实盘")
RISK_WARNING = ("别真跟", "图一乐", "谨慎", "风险", "参考", "娱乐")
RISK_FINANCE = ("股票", "量化", "交易", "买入", "持有", "开盘", "自选股")
FEEDBACK_POSITIVE = ("挺准", "很准", "准", "回本", "大跌", "有意思", "厉害")
FEEDBACK_CONCERN = ("回本", "大跌", "风险", "亏", "谨慎")
FEEDBACK_CURIOUS = ("api", "自动化", "行情", "信源")
OTHER_LINES = ("每一只", "具体", "示例", "案例", "实测", "演示", "列出来", "准确", "回本", "大跌", "卡牌", "路线")
OTHER_ITEMS = ("每一只", "具体的股票", "自选股", "股票")
OTHER_SAMPLES = ("实测", "案例", "演示")
STORY_LABELS = ("core_topic", "workflow", "implementation", "risk", "viewer_feedback", "other")
PLACEHOLDERS = (
    "^视频主要围绕《.+》展开，重点说明其中的核心做法。?$",
    "^视频核心是在讲《.+》的使用方法和落地流程。?$",
    "^视频核心是在讲《.+》的玩法思路和关键套路。?$",
    "^视频把核心流程拆成了几个连续环节，从输入材料到结果输出都有交代。?$",
    "^视频还补充了若干细节和示例，帮助理解真正落地时会遇到什么问题。?$",
)
SENTENCES = {
    "core_game": ("视频核心是在讲《", "》的玩法思路和关键套路。"),
    "core_tutorial": ("视频核心是在讲《", "》的使用方法和落地流程。"),
    "core_plain": ("视频主要围绕《", "》展开，重点说明其中的核心做法。"),
    "workflow_tutorial": "视频把关键流程拆成了输入、配置和运行几个环节，重点在把方案真正跑起来。",
    "workflow_game": "视频按构筑思路、关键资源和实战处理顺序来讲解整个打法。",
    "workflow_plain": "视频把核心流程拆成了几个连续环节，从输入材料到结果输出都有交代。",
    "implementation_tools": "实现上依赖 GitHub、服务器或自动化工作流，把整套分析流程持续跑起来。",
    "implementation_data": "系统会结合行情、业绩和多种数据源来做判断，而不只是给一句结论。",
    "implementation_plain": "实现层面强调了工具、数据或配置细节，说明这不是单纯口头推荐。",
    "risk_warning": "视频明确提醒这更像技术展示和参考，不建议盲目跟单或直接照搬投资决策。",
    "risk_plain": "内容涉及投资判断，实际操作仍需自行复核，不能把系统建议直接当成确定结论。",
    "feedback_mixed": "评论区一边在讨论信号准度，一边也拿回本和涨跌结果来检验这套方法是否靠谱。",
    "feedback_curious": "评论区主要在追问自动化交易、数据源和这套方案能否继续扩展到更多场景。",
    "feedback_positive": "评论区对这套自动化分析的效果和可用性表现出明显兴趣。",
    "feedback_plain": "评论区主要围绕实盘体验、可靠性和使用边界展开讨论。",
    "other_items": "视频还给出了更细的逐项说明，强调结果不是只看一个总分或一句结论。",
    "other_samples": "视频还补充了示例和实测片段，用来说明方法落地后的实际表现。",
    "other_plain": "视频还补充了若干细节和示例，帮助理解真正落地时会遇到什么问题。",
}


def pick_lines(lines: Column, keywords: Iterable[str], limit: int = 3, exclude: Column | None = None) -> Column:
    """First distinct lines of 6-120 characters that hold a keyword, clocks removed."""
    keywords = tuple(keywords)
    plain = F.transform(lines, tx.strip_timestamp)
    kept = F.filter(
        plain, lambda x: F.length(x).between(6, 120) & (tx.contains_any(x, keywords) | tx.contains_any(F.lower(x), keywords))
    )
    if exclude is not None:
        kept = F.filter(kept, lambda x: ~F.array_contains(exclude, x))
    return ar.take(F.array_distinct(kept), limit)


def _fallback_line(lines: Column, exclude: Column | None = None) -> Column:
    plain = F.filter(F.transform(lines, tx.strip_timestamp), lambda x: F.length(x).between(8, 120))
    if exclude is not None:
        plain = F.filter(plain, lambda x: ~F.array_contains(exclude, x))
    return ar.take(plain, 1)


def story_blocks(df: DataFrame, out: str = "story_blocks") -> DataFrame:
    """Add up to six labelled blocks: array<struct<label,summary,evidence>>.

    Expects ``source_kind, title, description, text, transcript, viewer_feedback``
    and the line arrays ``timeline_highlights, transcript_timeline,
    subtitle_timeline, ocr_lines, keyframe_text``. Items without any line track or
    feedback get no blocks.
    """
    title, desc = tx.squash(tx.text_or_empty(F.col("title"))), tx.squash(tx.text_or_empty(F.col("description")))
    names = ("timeline_highlights", "transcript_timeline", "subtitle_timeline", "ocr_lines", "keyframe_text")
    tracks = [F.transform(ar.or_empty(F.col(n)), lambda x: tx.squash(x)) for n in names]
    heads = F.array(
        F.when(title != "", F.concat(F.lit("标题: "), title)), F.when(desc != "", F.concat(F.lit("简介: "), desc))
    )
    heads = F.array_compact(heads)
    feedback = ar.take(
        F.array_distinct(F.filter(F.transform(ar.or_empty(F.col("viewer_feedback")), lambda x: tx.squash(x)), lambda x: x != "")), 5
    )
    df = df.withColumns(
        {"_title": title, "_heads": heads, "_fb": feedback, "_lines": ar.keep_first(F.concat(heads, *tracks))}
    )
    rich = [F.size(ar.or_empty(F.col(n))) > 0 for n in names[:4]] + [F.size("_fb") > 0]
    corpus = F.concat_ws(
        "\n", "_title", desc, tx.text_or_empty(F.col("text")), tx.text_or_empty(F.col("transcript")),
        F.array_join("_lines", "\n"), F.array_join("_fb", "\n"),
    )
    df = df.withColumns({"_corpus": corpus, "_rich": tx.any_of(rich) & (F.col("source_kind") == "video_url")})
    c, low, lines = F.col("_corpus"), F.lower(F.col("_corpus")), F.col("_lines")
    say = SENTENCES

    def about(key: str) -> Column:
        return F.concat(F.lit(say[key][0]), tx.topic_of_title(F.col("_title")), F.lit(say[key][1]))

    def block(label: str, summary: Column, evidence: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), summary.alias("summary"), ar.take(evidence, 3).alias("evidence"))

    core = block(
        "core_topic",
        F.when(tx.contains_any(c, GAME), about("core_game")).when(tx.contains_any(c, TUTORIAL), about("core_tutorial")).otherwise(about("core_plain")),
        ar.keep_first(F.concat(F.col("_heads"), _fallback_line(lines)), 3),
    )
    df = df.withColumns(
        {
            "_wf": pick_lines(lines, WORKFLOW_LINES),
            "_im": pick_lines(lines, IMPLEMENTATION_LINES),
            "_rk": pick_lines(lines, RISK_LINES),
        }
    )
    workflow = block(
        "workflow",
        F.when(tx.contains_any(c, WORKFLOW_TUTORIAL), F.lit(say["workflow_tutorial"]))
        .when(tx.contains_any(c, WORKFLOW_GAME), F.lit(say["workflow_game"]))
        .otherwise(F.lit(say["workflow_plain"])),
        F.col("_wf"),
    )
    implementation = block(
        "implementation",
        F.when(tx.contains_any(low, IMPLEMENTATION_TOOLS), F.lit(say["implementation_tools"]))
        .when(tx.contains_any(c, IMPLEMENTATION_DATA), F.lit(say["implementation_data"]))
        .otherwise(F.lit(say["implementation_plain"])),
        F.col("_im"),
    )
    finance_lines = ar.take(F.filter(lines, lambda x: tx.contains_any(x, RISK_FINANCE)), 3)
    risk = block(
        "risk",
        F.when(tx.contains_any(c, RISK_WARNING), F.lit(say["risk_warning"])).otherwise(F.lit(say["risk_plain"])),
        F.when(F.size("_rk") > 0, F.col("_rk")).otherwise(finance_lines),
    )
    joined = F.array_join("_fb", " ")
    positive, concern = tx.contains_any(joined, FEEDBACK_POSITIVE), tx.contains_any(joined, FEEDBACK_CONCERN)
    reader = block(
        "viewer_feedback",
        F.when(positive & concern, F.lit(say["feedback_mixed"]))
        .when(tx.contains_any(F.lower(joined), FEEDBACK_CURIOUS), F.lit(say["feedback_curious"]))
        .when(positive, F.lit(say["feedback_positive"]))
        .otherwise(F.lit(say["feedback_plain"])),
        F.col("_fb"),
    )
    has_risk = (F.size("_rk") > 0) | tx.contains_any(c, RISK_FINANCE)
    first = F.array_compact(
        F.array(
            core,
            F.when(F.size("_wf") > 0, workflow),
            F.when(F.size("_im") > 0, implementation),
            F.when(has_risk, risk),
            F.when(F.size("_fb") > 0, reader),
        )
    )
    df = df.withColumn("_blocks", first)
    used = F.flatten(F.transform("_blocks", lambda b: b["evidence"]))
    df = df.withColumn("_used", used)
    extra = pick_lines(lines, OTHER_LINES, exclude=F.col("_used"))
    df = df.withColumn("_extra", F.when(F.size(extra) > 0, extra).otherwise(_fallback_line(lines, F.col("_used"))))
    other = block(
        "other",
        F.when(tx.contains_any(c, OTHER_ITEMS), F.lit(say["other_items"]))
        .when(tx.contains_any(c, OTHER_SAMPLES), F.lit(say["other_samples"]))
        .otherwise(F.lit(say["other_plain"])),
        F.col("_extra"),
    )
    wants_other = (F.size("_blocks") < 3) & (F.size("_extra") > 0)
    blocks = F.when(wants_other, F.concat(F.col("_blocks"), F.array(other))).otherwise(F.col("_blocks"))
    empty = F.slice(F.col("_blocks"), 1, 0)
    df = df.withColumn(out, F.when(F.col("_rich"), ar.take(blocks, 6)).otherwise(empty))
    return df.drop(*[n for n in df.columns if n.startswith("_")])


def is_placeholder(summary: Column) -> Column:
    v = tx.squash(tx.text_or_empty(summary))
    return (v == "") | tx.any_of(v.rlike(p) for p in PLACEHOLDERS)


def blocks_qualified(blocks: Column) -> Column:
    """At least three blocks besides feedback, two of them with real content."""

    def body(own: Column) -> Column:
        return (F.size(own) >= 3) & (F.size(F.filter(own, lambda b: ~is_placeholder(b["summary"]))) >= 2)

    return tx.let(F.filter(blocks, lambda b: b["label"] != "viewer_feedback"), body)


def story_points(blocks: Column, include_feedback: bool = False, limit: int = 12) -> Column:
    """Block summaries of a qualified story, else nothing."""
    chosen = blocks if include_feedback else F.filter(blocks, lambda b: b["label"] != "viewer_feedback")
    points = ar.keep_first(F.transform(chosen, lambda b: tx.squash(b["summary"])), limit)
    return F.when(blocks_qualified(blocks), points).otherwise(ar.empty_strings())


def merge_media_evidence(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Build media evidence from supplied text tracks.

    Expects ``source_url, raw_text, metadata_text, subtitle, transcript`` (structs as
    made by ``parse_transcripts``), ``keyframes``, ``keyframe_text`` and
    ``ocr_lines``. Frame text only counts when speech is short or a frame shows a
    technical signal.
    """
    sub, spoken = tx.text_or_empty(F.col("subtitle.text")), tx.text_or_empty(F.col("transcript.text"))
    given = pr.split_guidance(F.col("raw_text"), F.lit("video_url"), F.col("source_url"))
    df = df.withColumns({"_g": given, "ocr_lines": cp.salient_lines(F.col("ocr_lines"), 16)})
    technical = F.exists(
        "ocr_lines",
        lambda x: tx.contains_any(F.lower(x), ("github", "http://", "https://", "skill")) | tx.has_slug(x),
    )
    use_ocr = (F.size("ocr_lines") > 0) & ((F.length(tx.strip(spoken)) < 160) | technical)
    ocr_block = F.when(use_ocr, F.concat(F.lit("[关键帧OCR]\n"), F.array_join("ocr_lines", "\n"))).otherwise(F.lit(""))
    merged = ar.merge_blocks(
        F.col("metadata_text"), sub, spoken, F.col("_g.evidence"), F.array_join(ar.or_empty(F.col("keyframe_text")), "\n"), ocr_block
    )
    df = df.withColumn("text", merged)
    m = cfg.media
    df = cp.compact_evidence(df, "text", "compact", max(40, m.max_evidence_lines), max(1200, m.max_evidence_chars))
    highlights = cp.timeline_highlights(F.col("transcript.timeline"), F.col("subtitle.timeline"), limit=8)
    df = df.withColumn("timeline_highlights", highlights)
    with_points = ar.merge_blocks(
        F.col("compact.text"),
        F.when(
            F.size("timeline_highlights") > 0,
            F.concat(F.lit("[视频时间线要点]\n"), F.array_join("timeline_highlights", "\n")),
        ),
    )
    durations = F.array_max(
        F.array(
            F.col("subtitle.duration_seconds"), F.col("transcript.duration_seconds"), tm.max_clock(sub), tm.max_clock(spoken)
        )
    )
    sources = F.array_compact(
        F.array(
            F.when(tx.strip(tx.text_or_empty(F.col("raw_text"))) != "", F.lit("user_raw_text")),
            F.when(tx.text_or_empty(F.col("metadata_text")) != "", F.lit("video_platform_metadata")),
            F.when(tx.strip(sub) != "", F.lit("video_subtitles")),
            F.when(tx.strip(spoken) != "", F.lit("video_audio_asr")),
            F.when(F.size(ar.or_empty(F.col("keyframes"))) > 0, F.lit("video_keyframes")),
            F.when(F.size("ocr_lines") > 0, F.lit("video_keyframe_ocr")),
        )
    )
    tracks = F.struct(
        (tx.strip(sub) != "").alias("has_subtitle"),
        (tx.strip(spoken) != "").alias("has_transcript"),
        (F.size(ar.or_empty(F.col("keyframes"))) > 0).alias("has_keyframes"),
        (F.size("ocr_lines") > 0).alias("has_keyframe_ocr"),
        F.lit("subtitle_first").alias("audio_mode"),
    )
    df = df.withColumns(
        {
            "source_kind": F.lit("video_url"),
            "text": F.col("compact.text"),
            "user_guidance": F.col("_g.guidance"),
            "duration_seconds": F.round(durations, 3),
            "tracks": tracks,
            "evidence_sources": sources,
        }
    )
    df = signals.extract_signals(df)
    df = df.withColumns(
        {
            "text": with_points,
            "evidence_type": F.lit("multimodal_video"),
            "coverage": F.when(with_points != "", F.lit("full")).otherwise(F.lit("partial")),
        }
    )
    return profiles.finalize_evidence(df).drop("_g")


def matched_points(detected: Column, given: Column) -> Column:
    """struct(matched, missing, extra, order_preserved) of two point lists, duplicates kept."""

    def body(d: Column, g: Column) -> Column:
        matched = F.filter(d, lambda p: F.array_contains(g, p))
        ordered = F.filter(g, lambda p: F.array_contains(d, p))
        return F.struct(
            matched.alias("matched"),
            F.filter(d, lambda p: ~F.array_contains(g, p)).alias("missing"),
            F.filter(g, lambda p: ~F.array_contains(d, p)).alias("extra"),
            (ordered == matched).alias("order_preserved"),
        )

    normal = [F.transform(a, pr.normalize_point) for a in (detected, given)]
    return tx.let(normal[0], lambda d: tx.let(normal[1], lambda g: body(d, g)))


def block_hit(corpus: Column, block: Column) -> Column:
    """Does the summary text mention a story block? A missing block counts as hit."""
    said = pr.normalize_point(tx.text_or_empty(block["summary"]))
    shown = F.exists(
        ar.take(block["evidence"], 2), lambda x: (F.length(x) >= 8) & F.contains(corpus, pr.normalize_point(x))
    )
    return block.isNull() | ((said != "") & F.contains(corpus, said)) | F.coalesce(shown, F.lit(False))


def outline_recall(df: DataFrame, out: str = "outline", numbered: bool = True) -> DataFrame:
    """Compare summary bullets with the outline of the evidence.

    Expects ``outline_points`` (detected), ``bullets, conclusion, story_blocks,
    transcript``, and adds a struct with the comparison and a root cause. ``numbered``: whether bullets
    may start with a number, which isn't judged (lines of plain text don't; there ``It. `` is a sentence).
    """
    bullets = F.filter(F.transform(ar.or_empty(F.col("bullets")), lambda x: tx.strip(x)), lambda x: x != "")
    corpus = F.lower(F.concat_ws("\n", F.col("conclusion"), F.array_join(bullets, "\n")))

    def labelled(name: str) -> Column:
        return F.try_element_at(F.filter("story_blocks", lambda b: b["label"] == name), F.lit(1))

    own = F.filter("story_blocks", lambda b: b["label"] != "viewer_feedback")
    df = df.withColumns(
        {
            "_b": bullets,
            "_c": corpus,
            "_m": matched_points(F.col("outline_points"), bullets),
            "_raw": F.exists(bullets, lambda b: pr.is_raw_bullet(b, F.col("transcript"), numbered)),
        }
    )
    detected = F.size("outline_points") > 0
    hits = {n: block_hit(F.col("_c"), labelled(n)) for n in ("workflow", "risk", "viewer_feedback")}
    cause = (
        F.when(F.col("_raw"), F.lit("raw_transcript_bullets"))
        .when(~hits["workflow"], F.lit("workflow_missing"))
        .when(~hits["risk"], F.lit("risk_missing"))
        .when(~hits["viewer_feedback"], F.lit("viewer_feedback_missing"))
        .when(
            detected & ((F.size("_b") < F.size("outline_points")) | (F.size("_m.missing") > 0)), F.lit("summary_compressed")
        )
        .when(detected & ~F.col("_m.order_preserved"), F.lit("order_mismatch"))
        .otherwise(F.lit("pass"))
    )
    result = F.struct(
        detected.alias("outline_detected"),
        F.col("_m.matched").alias("matched"),
        F.col("_m.missing").alias("missing"),
        F.when(detected, F.col("_m.extra")).otherwise(ar.empty_strings()).alias("extra"),
        (F.col("_m.order_preserved") | ~detected).alias("order_preserved"),
        (F.size(own) >= 3).alias("story_blocks_detected"),
        F.size(own).alias("story_block_count"),
        *[h.alias(f"{n}_hit") for n, h in hits.items()],
        (~F.col("_raw")).alias("bullet_quality_ok"),
        cause.alias("root_cause"),
    )
    return df.withColumn(out, result).drop("_b", "_c", "_m", "_raw")

