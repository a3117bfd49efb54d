"""Golden rows: fixed inputs with the results the rules must give."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.config import PageLimits
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import times as tm
from gleaner.functions import urls
from gleaner.operators import cases, compaction, evaluation, media, notes, pages, quality, search, segments, signals, snapshots, steps, summaries
from gleaner.operators import predicates as pr


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.youtube.com/watch?v=c7qJzG_swUE&utm_source=test&share_id=1", "https://www.youtube.com/watch?v=c7qJzG_swUE"),
        ("https://www.xiaohongshu.com/explore/699bf9a1000000001b01d4b7?xsec_token=abc&xsec_source=pc_feed",
         "https://www.xiaohongshu.com/explore/699bf9a1000000001b01d4b7"),
        ("HTTPS://Example.COM", "https://example.com/"),
        ("https://e.com/Path?a=&b=1#frag", "https://e.com/Path?b=1"),
        ("https://e.com/p?q=a%20b~*%C3%A9", "https://e.com/p?q=a+b~%2A%C3%A9"),
        ("  not a url ", "not a url"),
        (None, ""),
    ],
)
def test_canonical_url(one, url, want):
    got = one(lambda d: urls.canonical_url(d.u), u=url)
    assert got == want
    assert one(lambda d: urls.canonical_url(d.u), u=got) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.bilibili.com/video/BV1HpP5zBEEp?share_source=weixin&timestamp=1772551573", "https://www.bilibili.com/video/BV1HpP5zBEEp"),
        ("https://xiaohongshu.com/explore?app_platform=ios&type=video&target_note_id=69aea021000000001a028a59&xsec_token=abc",
         "https://www.xiaohongshu.com/explore/69aea021000000001a028a59"),
        ("https://www.xiaohongshu.com/login?redirectPath=https%3A%2F%2Fwww.xiaohongshu.com%2Fexplore%2F69aea021000000001a028a59",
         "https://www.xiaohongshu.com/explore/69aea021000000001a028a59"),
        ("https://example.com/a", "https://example.com/a"),
    ],
)
def test_platform_url(one, url, want):
    assert one(lambda d: urls.platform_url(d.u), u=url) == want


def test_repo_and_blob(one):
    u = "https://github.com/openai/openai-cookbook/blob/main/docs/README.md"
    assert one(lambda d: urls.repo_of(d.u), u=u) == "openai/openai-cookbook"
    assert tuple(one(lambda d: urls.blob_of(d.u), u=u)) == ("openai", "openai-cookbook", "main", "docs/README.md")
    assert one(lambda d: urls.repo_of(d.u), u="https://example.com/a/b") is None


@pytest.mark.parametrize(
    "link, want",
    [("/hero.png", "https://e.com/hero.png"), ("a/b.png", "https://e.com/x/a/b.png"), ("../c", "https://e.com/c"),
     ("//cdn.e.com/i", "https://cdn.e.com/i"), ("?p=1", "https://e.com/x/y?p=1"), ("http://o.org/z", "http://o.org/z")],
)
def test_resolve(one, link, want):
    assert one(lambda d: urls.resolve(F.lit("https://e.com/x/y"), d.l), l=link) == want


def test_titles_and_meta(one):
    assert one(lambda d: tx.refine_title(d.t), t="演示视频_哔哩哔哩_bilibili") == "演示视频"
    assert one(lambda d: tx.refine_title(d.t), t="GitHub - a/b - a/b") == "a/b"
    assert one(lambda d: tx.refine_title(d.t), t="") == "未命名内容"
    html = '<meta name="description" content="一个美股财报分析 Skill &amp; more"><title>T</title><meta property="og:title" content="OG">'
    assert one(lambda d: tx.meta_description(d.h), h=html) == "一个美股财报分析 Skill & more"
    assert one(lambda d: tx.page_title(d.h), h=html) == "OG"
    assert one(lambda d: tx.first_sentence(d.t), t="这是第一句。这里是第二句。") == "这是第一句"


def test_times(one):
    assert one(lambda d: tm.clock_label(d.s), s=3725.9) == "01:02:05"
    assert one(lambda d: tm.duration_words(d.s), s=3600.0) == "1小时"
    assert one(lambda d: tm.parse_duration(d.s), s="1500ms") == 1.5
    assert one(lambda d: tm.parse_duration(d.s), s="-3") is None
    assert one(lambda d: tm.max_clock(d.s), s="at 01:02 then 1:00:05 end") == 3605.0
    assert one(lambda d: tm.iso_utc(tm.parse_utc(d.s)), s="2026-03-17T08:00:00+08:00") == "2026-03-17T00:00:00Z"


def test_search_queries(one):
    site = one(lambda d: search.site_query(d.u, d.t, d.s), u="https://github.com/openai/openai-cookbook", t="GitHub - openai/openai-cookbook", s="")
    assert "site:github.com" in site
    assert "openai" in one(lambda d: search.broad_query(d.t, d.s, ar.empty_strings()), t="GitHub - openai/openai-cookbook", s="")


def test_legal_footer(one):
    line = "沪ICP备13030189号 | 营业执照 | 增值电信业务经营许可证 | 网络文化经营许可证 | 个性化推荐算法"
    assert one(lambda d: pr.is_legal_footer(d.l), l=line)
    assert one(lambda d: pr.is_ui_noise(d.l), l=line)


@pytest.mark.parametrize(
    "line, want",
    [("Install Toolbox and bring up the | Guided setup with toolBox", False), ("STOOLBOX", False),
     ("curl -fsSL https://example.com/install.sh | bash", True), ("npm install -g x", True), ("运行 npm install", False),
     ("https://example.com", False), ("toolbox is a nice thing", False)],
)
def test_commands(one, line, want):
    assert one(lambda d: pr.is_command(d.l, products=("toolbox",)), l=line) is want


def test_gate(one):
    def gate(d):
        return pr.evidence_gate(d.k, d.t, d.u, d.s, d.src)

    base = {"k": "image", "t": "推荐一个 Skill\n技能ID: tech-earnings-deepdive\n链接: https://github.com/a/b", "u": None, "s": True, "src": []}
    assert one(gate, **base)
    assert not one(gate, **{**base, "k": "url", "t": "https://example.com/x", "s": False})
    assert not one(gate, **{**base, "k": "url", "t": "[fetch error] nothing " + "x" * 100, "s": True})
    assert one(gate, **{**base, "k": "url", "t": "x", "s": False, "src": ["web_blocked_notice"]})
    assert not one(gate, **{**base, "k": "url", "t": "x" * 79, "s": False})
    assert one(gate, **{**base, "k": "url", "t": "x" * 80, "s": False})
    assert one(gate, **{**base, "k": "pasted_text", "t": "x", "s": False})


def test_needs_ocr(one):
    assert one(lambda d: pr.needs_ocr(F.lit("url"), d.u, d.t), u="https://github.com/a/b", t="") is False
    assert one(lambda d: pr.needs_ocr(F.lit("url"), d.u, d.t), u="https://mp.weixin.qq.com/s/x", t="x" * 5000) is True


@pytest.mark.parametrize("sub, spoken, frames, ocr", [(a, b, c, d) for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1)])
def test_media_gate_tracks(one, sub, spoken, frames, ocr):
    names = ("has_subtitle", "has_transcript", "has_keyframes", "has_keyframe_ocr")
    tracks = F.struct(*[F.lit(bool(v)).alias(n) for n, v in zip(names, (sub, spoken, frames, ocr))])
    reasons = one(lambda d: pr.media_gate(F.lit("video_url"), d.t, tracks), t="x" * 180)
    assert reasons == ([] if sub or spoken else ["missing speech track (subtitle/transcript)"])


def test_auto_case_reason(one):
    def reason(d):
        return pr.auto_case_reason(d.k, d.dry, F.lit(None).cast("string"), d.w, d.c, d.q)

    base = {"k": "url", "dry": False, "w": [], "c": "full", "q": 0.6}
    assert one(reason, **base) == "summary_quality_low"
    assert one(reason, **{**base, "q": 0.72}) is None
    assert one(reason, **{**base, "w": ["fetch_failed: 500"]}) == "fetch_failed"
    assert one(reason, **{**base, "dry": True}) is None
    assert one(reason, **{**base, "k": "image"}) is None


def test_guidance(one):
    out = one(lambda d: pr.split_guidance(d.t, F.lit("video_url"), d.u), t="重点看视频里提到的项目和部署方式。", u="https://www.bilibili.com/video/BV1tyNNzxEpK")
    assert out["evidence"] == "" and "重点看" in out["guidance"]


# --- pages ---------------------------------------------------------------------------

PAGE = """
<html><head><title>Example Product</title></head><body><nav>Navigation</nav><main>
<h1>Example Product</h1><p>This is the first paragraph.</p><h2>Usage</h2><p>Run the tool with a URL.</p>
<img src="/hero.png" alt="hero image" /><img src="/logo.png" />
<video poster="/poster.jpg"><source src="/demo.mp4" /></video>
<iframe src="https://www.youtube.com/embed/x"></iframe><iframe src="https://ads.example.com/x"></iframe>
<table><caption>Metrics</caption><tr><th>Name</th><th>Value</th></tr><tr><td>Latency</td><td>Fast</td></tr></table>
<table><tr><td>single</td></tr></table>
</main><footer>Footer</footer></body></html>
"""


def test_structure_page(spark):
    df = spark.createDataFrame([(1, "https://example.com/demo", PAGE)], "page_id bigint, url string, html string")
    doc = pages.structure_pages(df).first()["doc"]
    assert doc["title"] == "Example Product"
    assert "This is the first paragraph." in doc["main_text"] and "Navigation" not in doc["main_text"]
    assert [(s["heading"], s["level"], s["content"]) for s in doc["sections"]] == [
        ("Example Product", 1, "This is the first paragraph."), ("Usage", 2, "Run the tool with a URL.")
    ]
    assert [(i["src"], i["alt"]) for i in doc["images"]] == [("https://example.com/hero.png", "hero image")]
    assert [(v["src"], v["poster"], v["provider"]) for v in doc["videos"]] == [
        ("https://example.com/demo.mp4", "https://example.com/poster.jpg", "example.com"),
        ("https://www.youtube.com/embed/x", None, "youtube"),
    ]
    assert len(doc["tables"]) == 1
    assert doc["tables"][0]["caption"] == "Metrics" and doc["tables"][0]["headers"] == ["Name", "Value"]
    assert doc["tables"][0]["rows"] == [["Name", "Value"], ["Latency", "Fast"]]
    text = pages.structure_pages(df).select(pages.document_text(pages.extractive_document(F.col("doc"))).alias("t")).first()["t"]
    assert text.startswith("标题: Example Product\n摘要: This is the first paragraph. Run the tool with a URL.\n[章节]\n")
    assert "[表格]\n表格标题: Metrics\n表头: Name | Value\n行: Name | Value\n行: Latency | Fast" in text


def test_page_without_headings_gets_a_fallback_section(spark):
    html = "<html><head><title>T</title></head><body><p>" + "word " * 400 + "</p></body></html>"
    df = spark.createDataFrame([(1, "https://e.com", html)], "page_id bigint, url string, html string")
    sections = pages.structure_pages(df).first()["doc"]["sections"]
    assert len(sections) == 1 and sections[0]["heading"] == "T" and sections[0]["content"].split() == ["word"] * 400
    short = pages.structure_pages(df, limits=PageLimits(fallback_section_chars=1200)).first()["doc"]["sections"]
    assert len(short[0]["content"]) <= 1203


def test_article_text(one):
    wechat = '<div>nav</div><div id="js_content"><p>第一段正文内容，长度足够长。</p><p>第二段正文内容，也应该被提取出来。</p></div>'
    out = one(lambda d: pages.article_text(d.h, F.lit("https://e.com")), h=wechat)
    assert "第一段正文内容" in out and "第二段正文内容" in out and "nav" not in out
    article = "<div class='header'>首页 导航</div><article><h1>标题</h1><p>这里是一篇较长的正文内容，包含真实的信息，而不是菜单项。</p><p>第二段继续补充文章内容，用于验证正文块提取。</p></article>"
    out = one(lambda d: pages.article_text(d.h, F.lit("https://e.com")), h=article)
    assert "第二段继续补充文章内容" in out and "首页" not in out


# --- signals ---------------------------------------------------------------------------


@pytest.fixture
def sig(spark):
    def run(text, url=None):
        df = spark.createDataFrame([(text, url)], "text string, source_url string")
        return signals.extract_signals(df).first()["signals"].asDict()

    return run


def test_signals_links_and_skills(sig):
    s = sig(
        "推荐一个「美股财报深度分析」Skill\nhttps://github.com/VoltAgent/awesome-skills\n"
        "https://creator.xiaohongshu.com/publish/publish?source=official\ntech-earnings-deepdive\n#skill #美股",
        "https://www.xiaohongshu.com/explore/abc",
    )
    assert "美股财报深度分析 Skill" in s["skills"]
    assert "https://github.com/VoltAgent/awesome-skills" in s["links"]
    assert not any("creator." in u for u in s["links"])
    assert "tech-earnings-deepdive" in s["skill_ids"]
    assert s["hashtags"] == ["#skill", "#美股"]


def test_signals_adjacent_punctuation(sig):
    raw = "https://github.com/Day1Global/Day1Global-Skills/raw/main/tech-earnings-deepdive.skill"
    s = sig(f"安装命令 /install-skill {raw}。项目地址：https://github.com/star23/Day1Global-Skills。")
    assert raw in s["links"] and "https://github.com/star23/Day1Global-Skills" in s["links"]
    assert not any("项目地址" in u for u in s["links"])


def test_signals_repositories(sig):
    s = sig("github.com\nstar23/ Day1Global-Skills Public\n", "https://www.xiaohongshu.com/explore/abc")
    assert s["projects"] == ["star23/Day1Global-Skills"] and "https://github.com/star23/Day1Global-Skills" in s["links"]
    assert sig("github.com\n00:00 / 01:43\n", "https://www.bilibili.com/video/BV1HpP5zBEEp")["projects"] == []
    s = sig("Baillie Gifford/ARK\nhttps://github.com/star23/Day1Global-Skills", "https://github.com/star23/Day1Global-Skills")
    assert s["projects"] == ["star23/Day1Global-Skills"]


def test_signals_skill_ids_and_video_source(sig):
    s = sig("This Skill automatically generates an institutional-grade deep analysis report.\nskill id: tech-earnings-deepdive")
    assert s["skill_ids"] == ["tech-earnings-deepdive"]
    assert sig("视频介绍了全球热点。", "https://www.bilibili.com/video/BV1HpP5zBEEp")["links"] == ["https://www.bilibili.com/video/BV1HpP5zBEEp"]


def test_tighten_signals(spark):
    url = "https://github.com/a/b"
    df = spark.createDataFrame([("https://github.com/x/y\nhttps://github.com/a/b/raw/main/k.skill\nhttps://pypi.org/z", url)], "text string, source_url string")
    out = signals.extract_signals(df).select(signals.tighten_signals(F.col("signals"), F.col("source_url")).alias("s")).first()["s"]
    assert out["projects"] == ["a/b"]
    assert out["links"] == [url, "https://github.com/a/b/raw/main/k.skill"]


# --- steps and outline ---------------------------------------------------------------------


def test_step_lines(one):
    text = "一、安装nodejs\n官方下载地址：https://nodejs.org/zh-cn/download\n二、开始安装\n一）设置 PowerShell 执行权限\n命令：Set-ExecutionPolicy RemoteSigned -Scope CurrentUser"
    out = one(lambda d: steps.step_lines(d.t), t=text)
    for want in ("一、安装nodejs", "二、开始安装", "一）设置 PowerShell 执行权限", "命令：Set-ExecutionPolicy RemoteSigned -Scope CurrentUser"):
        assert want in out
    assert one(lambda d: steps.step_lines(d.t), t="命令：" + "x y " * 60) == []


def test_step_items(one):
    text = "前言\n一、安装环境\n先准备好电脑和网络环境\n命令：npm install -g tool\n二、启动\ncurl -fsSL https://e.com/i.sh | bash\n说明："
    out = [tuple(i) for i in one(lambda d: steps.step_items(d.t), t=text)]
    assert out == [("一、安装环境", "先准备好电脑和网络环境", "npm install -g tool"), ("二、启动", None, "curl -fsSL https://e.com/i.sh | bash")]


def test_enumerated_points(one):
    nine = "\n".join(f"{i}. 第{i}个关键点" for i in range(1, 10))
    assert one(lambda d: steps.enumerated_points(d.t), t=nine) == [f"第{i}个关键点" for i in range(1, 10)]
    assert one(lambda d: steps.enumerated_points(d.t), t="一、先做A\n二、再做B\n三、最后做C") == ["先做A", "再做B", "最后做C"]
    assert one(lambda d: steps.enumerated_points(d.t), t="1. 甲甲甲\n2. 乙乙乙\n4. 丁丁丁") == []
    assert one(lambda d: steps.enumerated_points(d.t), t="1. 甲甲甲\n2. 乙乙乙") == []


def test_sequence_and_timestamp_points(one):
    assert one(lambda d: steps.sequence_points(d.t), t="首先准备环境。然后运行脚本。最后检查结果。") == ["准备环境", "运行脚本", "检查结果"]
    assert one(lambda d: steps.timestamp_points(d.t), t="[00:01] 开场白内容\nx\n[01:02:03] 第二段内容") == ["开场白内容", "第二段内容"]


def test_ranked_chunks(one):
    out = one(lambda d: steps.ranked_chunks(d.t), t="开头 第3名：甲。第2名 乙，第2名 重复 第一名 丙！好了以上就是全部")
    assert [(r["rank"], r["content"]) for r in out] == [(3, "甲"), (2, "乙"), (1, "丙")]


def test_outline_recall(spark):
    blocks = "array<struct<label:string,summary:string,evidence:array<string>>>"
    df = spark.createDataFrame(
        [(["先做a", "再做b", "最后做c"], ["1. 先做A", "3. 最后做C", "2. 再做B"], "视频介绍了三步。", [], "")],
        f"outline_points array<string>, bullets array<string>, conclusion string, story_blocks {blocks}, transcript string",
    )
    out = media.outline_recall(df).first()["outline"]
    assert out["outline_detected"] and out["missing"] == [] and not out["order_preserved"]
    assert out["root_cause"] == "order_mismatch"


# --- compaction ------------------------------------------------------------------------------


def test_compaction_keeps_signal_within_budget(spark):
    noise = "\n".join("点赞 投币 收藏" for _ in range(180))
    body = "\n".join(f"[{i:02d}:00] 这是教程说明第{i}段，包含环境配置与部署细节。" for i in range(1, 90))
    signal = "安装命令：/install-skill https://github.com/star23/Day1Global-Skills"
    df = spark.createDataFrame([(f"{noise}\n{body}\n{signal}",)], "text string")
    out = compaction.compact_evidence(df, max_lines=80, max_chars=1200).first()["compact"]
    assert out["kept_chars"] <= 1200 and "/install-skill" in out["text"]
    assert out["text"].splitlines()[0] == signal
    assert out["raw_lines"] == 270


def test_highlights(one):
    lines = ["[00:10] 安装部署教程开始了，注意看", "普通句子", "[00:05] 点赞收藏", "[00:20] 命令在这里 https://github.com/a/b", "[00:20] 命令在这里 https://github.com/a/b"]
    assert one(lambda d: compaction.timeline_highlights(d.l), l=lines)[:2] == [lines[3], lines[0]]


# --- transcripts ----------------------------------------------------------------------------


def test_transcripts(spark):
    payload = json.dumps(
        {"text": "", "language": "zh_cn", "duration_seconds": 420.024, "segments": [
            {"start": 0.0, "end": 15.48, "text": "今天给大家介绍一个量化玩法。"},
            {"start": 15.48, "end": 29.46, "text": "会在每天早上开盘之前给你建议。"},
            {"start": 198.66, "end": 215.64, "text": "我把 github 部署接起来了。"}]},
        ensure_ascii=False,
    )
    df = spark.createDataFrame([(payload,), ('{"text":"","language":"zh","segments":[]}',), ("plain 01:05 text",), ("{broken",)], "p string")
    a, b, c, d = [r["transcript"] for r in segments.parse_transcripts(df, "p").collect()]
    assert "开盘之前" in a["text"] and a["language"] == "zh_cn" and a["duration_seconds"] == 420.024 and len(a["timeline"]) == 3
    assert a["timeline"][2] == "[03:18] 我把 github 部署接起来了。"
    assert b["text"] == "" and b["language"] == "zh"
    assert c["text"] == "plain 01:05 text" and c["duration_seconds"] == 65.0
    assert d["text"] == "{broken"
    asr = segments.normalize_transcription(df, "p").first()["asr"]
    assert asr["text"].startswith("今天给大家") and asr["duration_seconds"] == 420.024 and len(asr["segments"]) == 3


def test_vtt(one):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\nHello <b>there</b>\nfriend\n\n00:03.000 --> 00:04.000\nHello there friend\n\n01:00:00.000 --> 01:00:01.000\nlate"
    out = one(lambda d: segments.vtt_segments(d.v), v=vtt)
    assert [(s["start"], s["end"], s["text"]) for s in out] == [(1.0, 2.5, "Hello there friend"), (3600.0, 3601.0, "late")]
    assert len(one(lambda d: segments.vtt_segments(d.v, 10), v=vtt)) == 1


def test_best_caption(spark):
    df = spark.createDataFrame([("v", "x.live_chat.zh.vtt"), ("v", "x.en.vtt"), ("v", "x.zh.orig.vtt"), ("v", "x.zh.vtt")], "k string, name string")
    assert segments.best_caption(df, "k", "name", ("zh", "en")).first()["name"] == "x.zh.vtt"


# --- snapshots --------------------------------------------------------------------------------

COMMENTS = """
        - heading "评论" [level=2]
        - generic [ref=e271]:
          - generic [ref=e277]:
            - generic [ref=e280]:
              - link "Mmming1011" [ref=e282] [cursor=pointer]
            - paragraph [ref=e292]:
              - text: 你
              - link "2月28日" [ref=e293] [cursor=pointer]
              - text: 强烈建议买入的
              - link "中科曙光" [ref=e295] [cursor=pointer]
              - text: ，到昨天才回本
        - generic [ref=e314]:
          - generic [ref=e322]:
              - link "圆圆小缘_" [ref=e324] [cursor=pointer]
            - paragraph [ref=e334]:
              - text: 可以让工具实现美股市场的选股及自动化交易套利吗
        - generic [ref=e360]:
            - generic [ref=e363]:
              - link "以太与弦Justice" [ref=e367] [cursor=pointer]
            - paragraph [ref=e373]: 6 那你得上最猛的模型最猛的信源 要钱的
        - generic [ref=e391]:
            - generic [ref=e399]:
              - link "路人甲" [ref=e401] [cursor=pointer]
            - generic [ref=e411]:
              - paragraph [ref=e413]: 3月3号的 还挺准 让卖的都大跌
"""


def test_snapshot_comments(one):
    out = one(lambda d: snapshots.snapshot_comments(d.s, F.lit("以太与弦Justice")), s=COMMENTS)
    assert out == ["你2月28日强烈建议买入的中科曙光，到昨天才回本", "3月3号的 还挺准 让卖的都大跌"]


def test_snapshot_text_and_hits(one):
    body = """
    - generic [ref=e60]:
      - paragraph [ref=e61]:
        - link "沪ICP备13030189号" [ref=e62]
        - /url: https://creator.xiaohongshu.com/publish/publish?source=official
    - generic [ref=e174]: 推荐一个「美股财报深度分析」Skill
    - generic [ref=e176]:
      - text: 最近在X上看到有人分享的一个美股财报分析 Skill 我试用了一下 确实挺实用
      - /url: https://github.com/VoltAgent/awesome-skills
    - generic [ref=e209]: 你这个是手机app吗？
    """
    text = one(lambda d: snapshots.snapshot_text(d.s), s=body)
    assert "美股财报分析 Skill" in text and "github.com/VoltAgent/awesome-skills" in text
    assert "沪ICP备" not in text and "creator." not in text and "手机app" not in text
    hits = one(
        lambda d: snapshots.snapshot_hits(d.s),
        s='- link "OpenAI Cookbook"\n- /url: https://github.com/openai/openai-cookbook\n- text: Examples and guides for using the OpenAI API\n'
        '- generic [ref=e1]: notebooks and setup\n- link "Python Tutorial"\n- /url: https://docs.python.org/3/\n- text: Learn',
    )
    assert len(hits) == 2 and hits[0]["title"] == "OpenAI Cookbook"
    assert hits[0]["snippet"] == "Examples and guides for using the OpenAI API notebooks and setup"


def test_sanitize_media_page(one):
    text = "2026-03-02 14:15:01\n00:02 / 00:47\n平民版彭博终端来了！我用开源situation monitor一屏看完 | Github项目\n我怎么觉得十几年前就用个这个 psv\n相关推荐"
    out = one(lambda d: snapshots.sanitize_media_page(d.t, d.n), t=text, n="平民版彭博终端来了！_哔哩哔哩_bilibili").split("\n")
    assert out[0] == "平民版彭博终端来了！" and any("situation monitor" in x for x in out)
    assert not any(x in out for x in ("00:02 / 00:47", "相关推荐", "我怎么觉得十几年前就用个这个 psv"))


# --- summaries, quality, evaluation ---------------------------------------------------------


def _signals(**kinds):
    return F.struct(*[ar.strings(*kinds.get(k, [])).alias(k) for k in lx.SIGNAL_KINDS])


def test_quality_score_detects_missing_signals(spark):
    df = spark.createDataFrame([("测试", "已提取核心事实。", ["一般描述", "无具体项目", "无具体ID"])], "title string, conclusion string, bullets array<string>")
    none = ar.empty_strings()
    df = df.select(
        "*", _signals(projects=["star23/Day1Global-Skills"], skill_ids=["tech-earnings-deepdive"]).alias("signals"),
        F.lit("skill_recommendation").alias("profile"), none.alias("quotes"), none.alias("actions"), F.lit("url").alias("source_kind"),
        F.lit("正文").alias("text"), none.alias("evidence_sources"), none.alias("gate_reasons"),
    )
    out = quality.quality_score(quality.signal_coverage(df)).first()["quality"]
    assert out["score"] < 0.8 and out["coverage"] < 1.0 and any("missing_signals" in r for r in out["reasons"])


def _case(spark, **values):
    row = {"evidence_text": "", "title": "t", "conclusion": "c", "bullets": [], "note": "", "min": 80}
    row.update(values)
    df = spark.createDataFrame([(row["evidence_text"], row["title"], row["conclusion"], row["bullets"], row["note"])],
                               "evidence_text string, title string, conclusion string, bullets array<string>, note string")
    none = ar.empty_strings()
    required = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in values.get("required", [])])
    required = required if values.get("required") else F.array().cast("array<struct<label:string,value:string>>")
    return df.select(
        "*", required.alias("required"), none.alias("forbidden"), F.lit(row["min"]).alias("min_evidence_chars"),
        F.lit(False).alias("require_action_checklist"), none.alias("signal_values"), none.alias("quotes"), none.alias("actions"),
    )


def test_step_scores(spark):
    out = evaluation.score_steps(_case(spark, evidence_text="some text that is long enough", required=[("skill_id", "tech-earnings")], min=20)).first()
    assert not out["extract_step"]["passed"] and out["extract_step"]["missing"] == ["skill_id:tech-earnings"]
    out = evaluation.score_steps(_case(spark, conclusion="已提取核心事实。", bullets=["a", "b", "c"])).first()
    assert not out["summary_step"]["passed"] and out["summary_step"]["forbidden_hits"] == ["已提取核心事实"]
    assert out["signals_step"]["score"] == 0.85 and out["signals_step"]["passed"]


def test_root_cause_order(spark):
    df = evaluation.score_steps(_case(spark, evidence_text="x", required=[("keyword", "absent")]))
    assert evaluation.overall(df).first()["root_cause"] == "extract"


def test_normalize_summary_extends_bullets_to_the_outline(spark):
    text = "\n".join(f"{i}. 第{i}个关键点" for i in range(1, 10))
    df = spark.createDataFrame([(1, "video_url", "https://example.com/video", text, "九个步骤视频", "full")],
                               "doc_id bigint, source_kind string, source_url string, text string, title string, coverage string")
    none = ar.empty_strings()
    s = F.struct(
        F.lit("九个步骤视频").alias("title"), F.lit("步骤").alias("primary_topic"), none.alias("secondary_topics"), none.alias("entities"),
        F.lit("视频介绍了多个步骤，逐个说明。").alias("conclusion"), ar.strings("1. 第1个关键点", "2. 第2个关键点").alias("bullets"), none.alias("evidence_quotes"),
        F.lit("full").alias("coverage"), F.lit("HIGH ").alias("confidence"), none.alias("note_tags"), none.alias("follow_up_actions"),
        F.lit("x").alias("timeliness"), F.lit("low").alias("effectiveness"), F.lit("skip").alias("recommendation_level"),
    )
    df = df.select(
        "*", _signals().alias("signals"), F.lit("video_explainer").alias("profile"), none.alias("gate_reasons"),
        F.array().cast("array<struct<label:string,summary:string,evidence:array<string>>>").alias("story_blocks"),
        F.array().cast("array<struct<title:string,detail:string,command:string>>").alias("step_items"),
        F.array().cast("array<struct<heading:string,level:int,content:string>>").alias("sections"), s.alias("s"),
    )
    parts = summaries.normalize_summary(df)
    out = parts.accepted.first()
    assert len(out["bullets"]) == 9 and out["bullets"][8] == "9. 第9个关键点"
    assert out["confidence"] == "high" and out["timeliness"] == "medium" and parts.rejected.count() == 0
    bad = df.withColumn("s", F.col("s").withField("conclusion", F.lit("")))
    parts = summaries.normalize_summary(bad)
    assert parts.accepted.count() == 0 and parts.rejected.first()["reject_reasons"] == ["missing conclusion"]


def test_priority_bullets(spark):
    sig = _signals(projects=["a/b", "c/d"], links=["https://github.com/c/d", "https://www.youtube.com/watch?v=1", "https://docs.x.org"], commands=["npm install x"])
    out = spark.range(1).select(summaries.priority_bullets(sig, F.lit("see https://github.com/c/d now"), F.lit("url")).alias("b")).first()["b"]
    assert out == ["项目名称: c/d", "GitHub地址: https://github.com/c/d", "视频链接: https://www.youtube.com/watch?v=1", "关键链接: https://docs.x.org/"]


def test_story_blocks(spark):
    none = ar.empty_strings()
    df = spark.createDataFrame(
        [("video_url", "量化选股演示", "", "用 github 部署的自动化流程", ["[00:10] 把自选股列表交给系统分析", "[00:20] 用 github 和服务器部署自动化", "[00:30] 大家谨慎参考别真跟"])],
        "source_kind string, title string, description string, text string, transcript_timeline array<string>",
    ).select("*", F.lit("").alias("transcript"), none.alias("timeline_highlights"), none.alias("subtitle_timeline"), none.alias("ocr_lines"),
             none.alias("keyframe_text"), ar.strings("这个还挺准的，回本了").alias("viewer_feedback"))
    blocks = media.story_blocks(df).first()["story_blocks"]
    assert [b["label"] for b in blocks] == ["core_topic", "workflow", "implementation", "risk", "viewer_feedback"]
    assert blocks[3]["evidence"] == ["大家谨慎参考别真跟"]
    assert media.story_blocks(df).select(media.blocks_qualified(F.col("story_blocks")).alias("q")).first()["q"]
    assert media.story_blocks(df.withColumn("source_kind", F.lit("url"))).first()["story_blocks"] == []


# --- notes and registry -----------------------------------------------------------------------


def test_note_tags(one):
    got = one(lambda d: notes.note_tags(d.t, F.lit("网络安全"), ar.empty_strings()), t=["AI", "股票", "AI", "0day", "ai"])
    assert got == ["AI", "股票", "0day", "网络安全"]


def test_keyword_category(one):
    assert one(lambda d: notes.category(d.c), c="交互设计 与 kpi驱动 的平台行为") == "产品体验"
    assert one(lambda d: notes.category(d.c), c="said again") is None
    assert one(lambda d: notes.category(d.c), c="use ai tools") == "AI工具"


def test_uri(one):
    assert one(lambda d: notes.note_uri("My Vault", d.p), p="a b/c*é.md") == "obsidian://open?vault=My%20Vault&file=a%20b/c%2A%C3%A9.md"


def test_merge_cases_prefers_manual(spark):
    schema = "ord bigint, id string, source_kind string, source_url string, raw_text string, platform_hint string, provenance string, labels array<string>, auto_reason string"
    manual = spark.createDataFrame([(0, "m", "url", "https://e.com", None, None, "manual", ["docs"], "")], schema)
    auto = spark.createDataFrame([(0, "a", "url", "https://e.com", None, None, "auto", ["auto", "docs"], "fetch_failed")], schema)
    for order in ((manual, auto), (auto, manual)):
        rows = cases.merge_cases(*order).collect()
        assert len(rows) == 1 and rows[0]["provenance"] == "manual" and rows[0]["id"] == "m"
        assert rows[0]["labels"] == ["docs", "auto"] and rows[0]["auto_reason"] == "fetch_failed"


def test_case_id(one):
    out = one(lambda d: cases.case_id(F.lit("url"), d.u, F.lit(None).cast("string"), F.lit("unknown")), u="https://E.com/Ä b")
    assert out.startswith("auto-https-e-com-b-") and len(out.rsplit("-", 1)[1]) == 8


@pytest.mark.parametrize(
    "text, want",
    [
        ("0997 a | b", "0997 a | b"), ("Call +1 555-8630", "Call +1 555-8630"), ("! 12 first. ? 10 second", "12 first."),
        ("!! two 2?", "two 2"), ("  0\n 0  ", "0 0"), ("!?。", "!?。"), ("", ""), (None, None),
    ],
)
def test_first_sentence(one, text, want):
    assert one(lambda d: tx.first_sentence(F.col("t")), t=text) == want
