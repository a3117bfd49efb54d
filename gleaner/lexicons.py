"""Vocabularies and constants the rules must agree on.

They are data, not logic. Every rule takes its vocabulary as an argument and
only defaults to the lists below.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: URL query keys that carry no identity --------------------
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "share_id", "share_source", "share_medium", "share_session_id", "share_from",
    "share_tag", "apptime", "shareRedId", "author_share", "xsec_source",
    "xsec_token", "spm_id_from", "from_spmid", "timestamp", "unique_k", "mid",
    "buvid", "vd_source",
)
#: Sampling additionally ignores these keys.
SAMPLING_EXTRA_KEYS = ("wechatWid", "wechatOrigin", "note_flow_source")
SAMPLING_DOMAINS = (
    "bilibili.com", "b23.tv", "xiaohongshu.com", "youtube.com", "youtu.be", "github.com", "docs.python.org",
    "developers.openai.com", "pinchtab.com", "cloud.tencent.com",
)
DOC_HOSTS = ("docs.python.org", "developers.openai.com", "pinchtab.com")
VIDEO_URL_TOKENS = (
    "bilibili.com/video/", "b23.tv/", "youtube.com/watch", "youtu.be/", "xiaohongshu.com/explore/",
)
ASSET_TOKENS = (".js", ".png", ".jpg", ".jpeg", ".webp", "service-worker", "socket-worker")

# --- fixed values: line noise ----------------------------------------------
LEGAL_FOOTER_TOKENS = (
    "沪ICP备", "营业执照", "增值电信业务经营许可证", "医疗器械网络交易服务第三方平台备案",
    "互联网药品信息服务资格证书", "违法不良信息举报电话", "网络文化经营许可证", "个性化推荐算法",
)
UI_NOISE_EXACT = (
    "发现", "直播", "发布", "通知", "我", "关注", "更多", "活动", "发送", "取消", "创作中心",
    "业务合作", "搜索小红书", "说点什么...", "共 19 条评论", "举报", "文章被收录于专栏：", "目录",
    "推荐阅读", "作者相关精选", "相关产品与服务", "热门产品", "社区", "圈层", "关于", "免责声明",
    "友情链接", "产品介绍", "产品文档", "加载更多", "交个朋友",
)
UI_NOISE_FILING = ("行吟信息科技", "版权所有", "备案号", "网络文化经营许可证", "违法和不良信息举报")
STEP_NOISE_TOKENS = (
    "代码语言", "AI代码解释", "为所有代码块添加", "定位问题代码", "目录", "推荐阅读", "注意：",
    "安全提示", "举报",
)
COMMENT_PREFIXES = ("你这个", "我是", "我想问", "请问", "有人知道", "本人hrbp")
COMMENT_TOKENS = ("评论", "回复", "共 ", "条评论")
COMMENT_REACTIONS = ("有用的", "心计", "笑死", "傻傻")
DEBUG_TOKENS = ("python 3.9", "yt-dlp", "unsupported url", "traceback", "systemexit(", "deprecated feature")
GENERIC_BULLET_TOKENS = (
    "内容完整", "覆盖全面", "适用于开发者", "信息完整", "提供了完整", "该证据", "该链接", "该项目",
)

# --- fixed values: reader feedback -----------------------------------------
FEEDBACK_BANNED_TOKENS = ("评论区", "条回复", "点击查看", "置顶", "展开", "收起")
FEEDBACK_QUESTION_ENDS = ("?", "？", "吗", "吗？", "吗?")
FEEDBACK_QUESTION_STARTS = ("如何", "怎么", "请问", "可以", "能否", "有没有")
FEEDBACK_REACTIONS = ("哈哈", "笑死", "牛", "绝了", "好家伙", "绷不住")

# --- fixed values: commands --------------------------------------------------
COMMAND_TOKENS = (
    "set-executionpolicy", "iwr ", "npm ", "node ", "brew ", "pip ", "python ", "curl ", "wget ", "git ",
)
COMMAND_PREFIXES = (
    "set-executionpolicy", "iwr ", "curl ", "wget ", "npm ", "node ", "pip ", "python ", "git ", "brew ",
    "bash ", "sh ",
)
COMMAND_PIPE_TOOLS = ("iwr", "curl", "wget", "npm", "python")
STEP_COMMAND_STOPWORDS = ("claude", "win", "enter", '"yes"', "yes")
STEP_COMMAND_PROSE = ("方法", "用法", "说明", "安装后", "直接用", "报告结构")

# --- fixed values: links and repositories ------------------------------------
HIGH_VALUE_DOMAINS = (
    "github.com", "gitee.com", "gitlab.com", "npmjs.com", "pypi.org", "huggingface.co", "docs.",
)
LOW_VALUE_DOMAINS = ("creator.xiaohongshu.com", "beian.cac.gov.cn", "icp.chinaz.com")
SAME_SITE_EXCLUDED = ("xiaohongshu.com",)
FORCED_SOURCE_LINKS = (
    "bilibili.com/video/", "youtube.com/watch", "youtu.be/", "vimeo.com/", "xiaohongshu.com/explore/",
)
REPO_RESERVED_WORDS = ("issues", "pull", "pulls", "actions", "wiki", "releases", "blob", "tree")
REPO_HOST_SUFFIXES = (".com", ".cn", ".org", ".net", ".io")
REPO_CONTEXT_TOKENS = ("github.com", "public", "private", "repository", "repo", "仓库")
VIDEO_PROVIDERS = ("youtube", "youtu.be", "bilibili", "vimeo", "xiaohongshu", "loom")
EMBED_PROVIDERS = ("youtube", "youtu.be", "bilibili", "vimeo", "loom")

# --- fixed values: skill signals ----------------------------------------------
SKILL_NAME_STOP = ("最近在", "看到有人", "分享", "试用", "安装方法")
SLUG_STOPLIST = (
    "install-skill", "institutional-grade", "long-term", "multi-method", "probability-weighted", "anti-bias",
    "position-sizing", "deep-analysis",
)

# --- fixed values: keyword lines -----------------------------------------------
KEYWORD_LINES = {
    "prerequisites": ("前置", "依赖", "需要安装", "requirement", "prerequisite"),
    "validation_actions": ("验证", "检查", "确认", "访问", "打开", "运行后", "完成后", "check", "verify"),
    "use_cases": ("可直接问", "可以直接问", "适合", "用于", "支持", "use it", "ask about"),
    "purposes": ("用于", "帮助", "介绍", "提供", "支持", "专注于", "能够"),
    "boundaries": ("不支持", "仅支持", "限制", "注意事项", "局限"),
    "common_errors": ("报错", "错误", "失败", "403", "quota", "insufficient", "forbidden"),
}
PREREQUISITE_STARTS = ("前置条件", "环境要求", "准备工作")
SIGNAL_KINDS = (
    "skills", "projects", "skill_ids", "commands", "links", "hashtags",
    "prerequisites", "validation_actions", "use_cases", "purposes", "boundaries", "common_errors",
)

# --- fixed values: content profiles ----------------------------------------------
PROFILE_REQUIRED = {
    "skill_recommendation": ("projects", "links", "skills", "skill_ids", "commands"),
    "installation_tutorial": ("commands",),
    "project_overview": ("projects", "links"),
    "video_explainer": ("links",),
    "general_capture": (),
}
PROFILE_OPTIONAL = {
    "skill_recommendation": ("use_cases", "validation_actions"),
    "installation_tutorial": ("prerequisites", "validation_actions", "common_errors"),
    "project_overview": ("purposes", "boundaries"),
    "video_explainer": ("purposes",),
    "general_capture": (),
}
PROFILES_WITH_CHECKLIST = ("skill_recommendation", "installation_tutorial")
PROFILES_WITH_PROJECT_SECTION = ("skill_recommendation", "installation_tutorial", "project_overview")


@dataclass(frozen=True)
class ProfileLexicon:
    skill: tuple[str, ...] = ("/install-skill", ".skill", " skill", "技能id", "skill id")
    install: tuple[str, ...] = ("安装", "教程", "步骤", "配置", "setup", "install", "前置条件")
    project: tuple[str, ...] = ("项目", "仓库", "repo", "repository", "readme")
    project_hosts: tuple[str, ...] = ("github.com/",)


# --- fixed values: line scores ----------------------------------------------------
@dataclass(frozen=True)
class MediaScoreLexicon:
    topical: tuple[str, ...] = (
        "github.com/", "http://", "https://", "skill", "/install-skill", "安装", "部署", "教程", "步骤", "命令",
        "架构", "总结", "结论", "实践", "实战",
    )
    links: tuple[str, ...] = ("github.com/", "http://", "https://")
    commands: tuple[str, ...] = ("/install-skill", "命令")
    chatter: tuple[str, ...] = ("点赞", "投币", "收藏", "弹幕", "评论区", "转发")


@dataclass(frozen=True)
class SalientLexicon:
    link_contains: tuple[str, ...] = ("github.com/",)
    link_starts: tuple[str, ...] = ("http://", "https://")
    skill: tuple[str, ...] = ("skill", "技能")
    labels: tuple[str, ...] = ("技能名:", "技能ID:", "命令:", "链接:", "项目:")
    product: tuple[str, ...] = ()
    noise: tuple[str, ...] = ("notifications", "issues", "pull requests", "sign in", "鼠标悬停", "说点什么")


#: (tokens, weight) rows of the additive document key-line score.
DOC_KEY_WEIGHTS = (
    (("/install-skill",), 10),
    ((".skill",), 9),
    (("kubelet",), 8),
    (("container runtime", "container-runtime"), 8),
    (("cgroup",), 4),
    (("installation", "install via url", "manual download"), 8),
    (("usage", "use cases", "basic usage", "advanced usage"), 6),
    (("report structure", "evidence standards"), 5),
    (("skill",), 4),
    (("github.com/",), 4),
    (("disclaimer", "license", "contributor", "copyright"), -4),
)
DOC_KEY_EXACT_NOISE = ("License", "MIT license", "Contributors", "Resources", "About", "Releases", "Packages")
DOC_KEY_NOISE = ("uh oh!", "error while loading", "watchers", "forks", "stars")
DOC_FOCUS_TERMS = ("kubelet", "container runtime", "container-runtime", "cri", "cgroup")

# --- fixed values: OCR lines -------------------------------------------------------
OCR_LOW_VALUE = (
    "notifications", "issues", "pull requests", "license", "stars", "forks", "sign in", "tags", "编辑于", "鼠标悬停",
    "说点什么",
)

# --- fixed values: media pages ---------------------------------------------------
MEDIA_PAGE_LOW_VALUE = (
    "相关推荐", "分p", "下一条", "播放", "弹幕", "点赞", "投币", "收藏", "转发", "关注", "评论", "排行榜", "热门", "投稿",
    "立即播放",
)
MEDIA_PAGE_SIGNALS = (
    "github", "开源", "教程", "讲解", "安装", "部署", "实测", "项目", "skill", "http://", "https://", "攻略", "新手",
    "基础流派", "薪资流水", "背调", "offer",
)
MEDIA_PAGE_CHATTER = ("我怎么", "这个就是", "十年前", "笑死", "离谱", "有没有人", "求个", "太离谱")

# --- fixed values: pages ------------------------------------------------------------
PAGE_NOISE_TAGS = ("script", "style", "nav", "footer", "form", "noscript")
PAGE_NOISE_CLASSES = (
    "toctree-wrapper", "sphinxsidebar", "related", "headerlink", "js-header-wrapper", "js-repo-nav", "Layout-sidebar",
)
PAGE_NOISE_PHRASES = (
    "uh oh! there was an error while loading", "additional navigation options", "skip to content",
    "public notifications", "you must be signed in to change notification settings",
    "navigation menu toggle navigation",
)
DECORATIVE_SRC = ("avatar", "gravatar", "githubassets", "octicon", "favicon", "icon", "logo")
DECORATIVE_ALT = ("avatar", "icon", "logo")

# --- fixed values: gates and errors ------------------------------------------------------
ERROR_TEXT_PREFIXES = (
    "[fetch error]", "[extractor error]", "[github fetch error]", "[github extractor error]", "[browser fetch error]",
)
BLOCKED_SOURCE = "web_blocked_notice"
WEAK_MEDIA_SOURCES = ("user_raw_text", "video_page_snapshot", "video_html_fallback")
GUIDANCE_TOKENS = (
    "帮我", "请你", "请帮", "我想看", "重点看", "重点提炼", "重点关注", "重点总结", "只看", "告诉我", "帮我归档", "帮我提取",
    "请总结", "请提炼",
)
GUIDANCE_TOKENS_LATIN = ("focus on", "summarize", "extract", "highlight")
TUTORIAL_TOKENS = ("安装", "教程", "步骤", "setup", "install", "/install-skill", "配置", "命令：", "how to")

# --- fixed values: summaries ------------------------------------------------------------
UNTITLED = "未命名内容"
UNCATEGORISED = "未分类"
QUALITY_GENERIC = ("已提取核心事实", "模型不可用", "帮助你快速")
SECOND_PERSON = ("你",)
PROJECT_BULLET_LABELS = ("项目名称:", "GitHub地址:", "关键链接:", "视频链接:", "技能名:", "技能ID:")
FACT_LABELS = (
    "项目名称", "GitHub地址", "视频链接", "关键链接", "技能名", "技能ID", "关键命令", "安装方法", "前置条件", "验证动作",
    "使用方式", "核心用途", "命令", "链接", "项目",
)
SUMMARY_FORBIDDEN = ("已提取核心事实", "模型不可用", "帮助你快速理解", "内容完整", "覆盖全面")
NOTE_FORBIDDEN = (
    "步骤细节", "图片与帧（后置）", "## 一句话总结", "## 文字脑图", "## 对你有什么用", "## 贾维斯判断", "## 项目与链接",
    "## 关联笔记", "## 核心事实", "## 执行清单", "## 关键证据", "## 专业解读", "## 可信度与局限", "## 关键词",
    "帮助你快速理解", "已提取核心事实", "对你有用", "推荐等级", "大厂程序员视角",
)
NOTE_ACTION_TOKENS = ("/install-skill", "执行", "安装", "验证", "运行", "步骤")
CHECKLIST_ACTION_TOKENS = ("/install-skill", "执行命令", "验证", "安装", "部署", "运行")
FIX_SUGGESTIONS = {
    "extract": "抓取阶段丢信息：优先补抓取链路（页面正文、OCR、字幕/ASR）并复测。",
    "signals": "信号抽取丢关键信息：补 regex 规则（repo/skill_id/link）并加回归样例。",
    "summary": "总结阶段漏关键事实：升级总结模型或加强提示词约束，再做 case 回放。",
    "summary_model": "总结模型调用失败：先修 API 可用性，再用强模型重跑并检查成本。",
    "renderer": "渲染阶段引入噪声：调整模板裁剪规则，禁用低价值段落。",
    "pass": "当前链路达标，可继续扩充更多真实样本回归。",
}
JUDGE_ROOT_CAUSES = ("pass", "extract", "signals", "summary", "renderer")

# --- fixed values: keyword hierarchy ---------------------------------------------------------
KEYWORD_CATEGORIES = (
    ("产品体验", ("交互设计", "用户体验", "产品经理", "kpi驱动", "kpi", "平台行为", "简中互联网", "反模式")),
    ("网络安全", ("0day", "漏洞", "二进制", "逆向", "摄像头", "iot", "安全", "exploit", "kali", "ida")),
    ("游戏", ("杀戮尖塔", "游戏", "卡牌", "流派", "攻略", "boss", "肉鸽", "steam")),
    ("股票投资", ("股票", "财报", "量化", "交易", "自选股", "美股", "投资", "大盘", "行情")),
    ("出海SaaS", ("saas", "出海", "支付", "海外公司", "订阅", "billing")),
    ("求职职场", ("薪资", "求职", "面试", "背调", "offer", "职场", "工资")),
    ("知识管理", ("obsidian", "知识管理", "笔记", "pkm", "claudian")),
    ("饮食健康", ("热量", "减脂", "饮食", "外出就餐", "大卡", "包子", "鸡蛋粥")),
    ("人物访谈", ("访谈", "方法论", "人生", "美国梦", "老兵", "故事", "对话")),
    ("AI工具", ("claude", "gpt", "ai", "agent", "skill", "rag", "模型")),
    ("编程开发", ("python", "kubernetes", "container runtime", "nodejs", "开发", "编程", "runtime", "docker")),
    ("开源项目", ("github", "开源", "repo", "仓库", "project")),
    ("效率工具", ("效率", "工作流", "自动化", "生产力", "工具")),
)
GENERIC_TOPICS = ("未分类", "视频", "图文", "内容", "链接", "网页", "文章")

# --- fixed values: ordinals ---------------------------------------------------------------
CHINESE_ORDINALS = {
    "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12,
}
