"""URL, text and line-predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import scoring as sc
from gleaner.functions import text as tx
from gleaner.functions import times as tm
from gleaner.functions import urls
from gleaner.operators import lines as ln
from gleaner.operators import predicates as pr
from gleaner.operators.keyed import salted_lookup
from gleaner.plans import base, sql
from gleaner.plans.registry import query

_SPLIT_URL = r"""parts AS (
      SELECT page_id, url, html,
             regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme,
             regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS netloc,
             regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
      FROM pages)"""


def _clean_query(keys) -> str:
    return f"""array_to_string(list_filter(string_split(query, '&'), lambda p: contains(p, '=')
             AND split_part(p, '=', 2) <> '' AND NOT starts_with(p, 'utm_')
             AND NOT split_part(p, '=', 1) IN ({", ".join(sql.lit(k) for k in keys)})), '&')"""


_CANONICAL = f"""canon AS (SELECT page_id, url, html, netloc, path,
             lower(scheme) || '://' || lower(netloc) || CASE WHEN path = '' THEN '/' ELSE path END
               || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url
      FROM (SELECT *, {_clean_query(lx.TRACKING_KEYS)} AS q FROM parts))"""


@query("url_canonical", f"WITH {_SPLIT_URL}, {_CANONICAL} SELECT page_id, canonical_url FROM canon")
def url_canonical(spark, sf_dir):
    df = base.pages(spark, sf_dir, "page_id", "url")
    return df.select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


_SAMPLE_KEYS = (*lx.TRACKING_KEYS, "ref")


@query(
    "url_canonical_sampling",
    f"""WITH {_SPLIT_URL}, x AS (SELECT *, {_clean_query(_SAMPLE_KEYS)} AS q FROM parts)
    SELECT page_id, scheme || '://' || netloc || CASE WHEN path = '' THEN '/' ELSE path END
           || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM x""",
)
def url_canonical_sampling(spark, sf_dir):
    """The case-keeping variant with a longer ignore list."""
    df = base.pages(spark, sf_dir, "page_id", "url")
    canonical = urls.canonical_url(F.col("url"), ignored=_SAMPLE_KEYS, keep_case=True)
    return df.select("page_id", canonical.alias("canonical_url"))


@query(
    "url_family",
    """SELECT page_id,
         CASE WHEN contains(lower(url), 'spam-farm.') OR contains(lower(url), 'cheap-pills.') THEN 'docs' ELSE 'web' END AS family,
         CASE WHEN contains(lower(url), 'spam-farm.') OR contains(lower(url), 'cheap-pills.') THEN 'docs_web' ELSE 'web_page' END AS bucket,
         'url' AS source_kind
       FROM pages""",
)
def url_family(spark, sf_dir):
    df = base.pages(spark, sf_dir, "page_id", "url")
    hosts = ("spam-farm.", "cheap-pills.")
    kind = urls.source_kind(F.col("url"))
    return df.select(
        "page_id",
        urls.family(F.col("url"), hosts).alias("family"),
        urls.bucket(F.col("url"), kind, hosts).alias("bucket"),
        kind.alias("source_kind"),
    )


@query(
    "url_match_keys",
    rf"""WITH {_SPLIT_URL} SELECT page_id, lower(netloc) AS host, split_part(url, '#', 1) AS match_url,
       netloc || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS path_key,
       lower(netloc) AS provider
       FROM parts""",
)
def url_match_keys(spark, sf_dir):
    df = base.pages(spark, sf_dir, "page_id", "url")
    u = F.col("url")
    return df.select(
        "page_id",
        urls.host(u).alias("host"),
        urls.match_url(u).alias("match_url"),
        urls.path_key(u).alias("path_key"),
        urls.video_provider(u).alias("provider"),
    )


@query(
    "url_predicates",
    r"""SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#\s]+') AS is_abs,
         contains(lower(url), 'example.org') AND NOT contains(lower(url), '.html') AS is_candidate,
         regexp_matches(url, '(?i)\.(png|jpg|jpeg|webp|bmp|gif)$') AS is_image,
         false AS is_direct_video,
         (contains(lower(url), 'example.org') OR contains(lower(url), 'blog.'))
           AND NOT contains(lower(url), 'spam-farm.') AS is_high_value
       FROM pages""",
)
def url_predicates(spark, sf_dir):
    u = F.col("url")
    return base.pages(spark, sf_dir, "page_id", "url").select(
        "page_id",
        pr.is_abs_url(u).alias("is_abs"),
        pr.is_candidate_url(u, allow=("example.org",), assets=(".html",)).alias("is_candidate"),
        pr.is_image_path(u).alias("is_image"),
        pr.is_direct_video(u).alias("is_direct_video"),
        pr.is_high_value_link(u, u, allow=("example.org", "blog."), deny=("spam-farm.",)).alias("is_high_value"),
    )


@query(
    "request_routes",
    f"""WITH {sql.REQUESTS} SELECT doc_id, CASE source_kind WHEN 'pasted_text' THEN 'text' WHEN 'image' THEN 'image'
         WHEN 'video_url' THEN 'video' ELSE 'web' END AS route,
         coalesce(source_url = text, false) AS url_only
       FROM requests""",
)
def request_routes(spark, sf_dir):
    df = base.requests(spark, sf_dir)
    return df.select(
        "doc_id",
        pr.route(F.col("source_kind"), F.col("source_url"), F.lit("")).alias("route"),
        pr.is_url_only(F.col("text"), F.col("source_url")).alias("url_only"),
    )


@query(
    "lines_exploded",
    f"WITH {sql.lines()} SELECT doc_id, pos, line FROM lines",
)
def lines_exploded(spark, sf_dir):
    return ln.explode_lines(base.documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


_FOOTER = ("License", "the ", "version", "Version", "under")
_UI_EXACT = ("The", "Of.", "Hetible th.", "And ornd.", "Ietzte.")
_UI_FILING = ("disgusting", "stupid", "scum")

_UI_SQL = rf"""(line IN ({", ".join(sql.lit(x) for x in _UI_EXACT)}) OR starts_with(line, '#')
      OR regexp_matches(line, '^\d+(/\d+)?$') OR ends_with(line, 'the.')
      OR {sql.contains_any("line", _UI_FILING)}
      OR ({" + ".join(f"CAST(contains(line, {sql.lit(t)}) AS INT)" for t in _FOOTER)}) >= 3)"""


def _ui(c):
    return pr.is_ui_noise(c, exact=_UI_EXACT, filing=_UI_FILING, footer=_FOOTER, author_suffix="the.")


@query(
    "ui_noise_lines",
    f"""WITH {sql.lines()} SELECT doc_id, pos, {_UI_SQL.replace("line", "v")} AS ui_noise,
        ({" + ".join(f"CAST(contains(line, {sql.lit(t)}) AS INT)" for t in _FOOTER)}) >= 3 AS legal_footer
        FROM (SELECT *, trim(trim(line), '"') AS v FROM lines)""",
)
def ui_noise_lines(spark, sf_dir):
    df = lines_exploded(spark, sf_dir)
    return df.select(
        "doc_id", "pos", _ui(F.col("line")).alias("ui_noise"), pr.is_legal_footer(F.col("line"), _FOOTER).alias("legal_footer")
    )


_REPLY, _REACT, _PREFIX = ("worthless", "trash"), ("ist", "and"), ("The ", "Er", "La ")


@query(
    "comment_noise_lines",
    f"""WITH {sql.lines()} SELECT doc_id, pos,
        (regexp_matches(line, '[?？]$') AND length(line) <= 36) OR {sql.starts_any("line", _PREFIX)}
        OR {sql.contains_any("line", _REPLY)} OR (length(line) <= 24 AND {sql.contains_any("line", _REACT)}) AS comment_noise,
        {sql.contains_any("line", ("token", "MIT", "GNU"))} AS step_noise
        FROM lines""",
)
def comment_noise_lines(spark, sf_dir):
    df = lines_exploded(spark, sf_dir)
    return df.select(
        "doc_id",
        "pos",
        pr.is_comment_noise(F.col("line"), _PREFIX, _REPLY, _REACT).alias("comment_noise"),
        pr.is_step_noise(F.col("line"), ("token", "MIT", "GNU")).alias("step_noise"),
    )


_CMD_TOKENS, _CMD_PREFIX, _CMD_PIPE = ("the ", "und "), ("the ", "in ", "and "), ("on", "er")


@query(
    "command_lines",
    rf"""WITH {sql.lines()}, w AS (SELECT *, lower(line) AS low, len(regexp_split_to_array(line, '\s+')) AS words FROM lines),
      f AS (SELECT *, {sql.starts_any("low", _CMD_PREFIX)} AS pre, contains(line, '|') AS piped,
              {sql.contains_any("low", _CMD_TOKENS)} AS mention FROM w)
      SELECT doc_id, pos, line FROM f WHERE
        CASE WHEN mention THEN pre OR words <= 3 ELSE piped AND {sql.contains_any("low", _CMD_PIPE)} END
        AND NOT (starts_with(line, 'http://') OR starts_with(line, 'https://') OR regexp_matches(line, '<[^>]+>')
                 OR regexp_matches(line, '[\x{{4e00}}-\x{{9fff}}]'))
        AND NOT (words > 7 AND piped AND NOT pre AND NOT {sql.contains_any("line", ("--", " /", chr(92), "=", ";"))})
        AND NOT (words > 5 AND NOT pre AND NOT {sql.contains_any("line", ("--", "&&", "||", " /", chr(92), "=", ";", "$"))})""",
)
def command_lines(spark, sf_dir):
    df = lines_exploded(spark, sf_dir)
    return df.filter(pr.is_command(F.col("line"), _CMD_TOKENS, _CMD_PREFIX, _CMD_PIPE))


@query(
    "repo_candidates",
    r"""WITH p AS (SELECT page_id, split_part(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '.', 1) AS owner,
          lower(trim(split_part(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/', 3), '.-_/')) AS repo FROM pages)
        SELECT page_id, regexp_matches(owner, '[a-z]') AND regexp_matches(repo, '[a-z]')
          AND NOT starts_with(owner, 'http') AND owner NOT IN ('wiki', 'blob') AND repo NOT IN ('wiki', 'blob')
          AND NOT regexp_matches(repo, '^[0-5]?\d(s|m|min|sec)?$') AS is_repo FROM p""",
)
def repo_candidates(spark, sf_dir):
    df = base.pages(spark, sf_dir, "page_id", "url")
    owner = F.substring_index(urls.host(F.col("url")), ".", 1)
    repo = F.coalesce(F.get(F.split(urls.path(F.col("url")), "/"), F.lit(2)), F.lit(""))
    return df.select("page_id", pr.is_repo(owner, repo).alias("is_repo"))


@query(
    "feedback_turns",
    f"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(trim(text), '[ \t]+', ' ', 'g') AS v FROM conversations)
        SELECT conv_id, turn, v AS text FROM t WHERE role <> 'assistant' AND length(v) BETWEEN 8 AND 90
          AND NOT ends_with(v, '?') AND NOT starts_with(v, '#') AND NOT regexp_matches(v, '^[0-9]+(/[0-9]+)?$')""",
)
def feedback_turns(spark, sf_dir):
    df = base.spread(base.read_table(spark, sf_dir, "conversations"))
    keep = pr.is_feedback(F.col("text"), F.col("role"), F.lit("assistant"))
    return df.filter(keep).select("conv_id", "turn", tx.normalize(F.col("text")).alias("text"))


@query(
    "page_noise_and_media",
    """SELECT page_id, contains(lower(url), 'spam') OR contains(lower(url), 'pills') OR contains(lower(url), '/es/') AS noise,
         contains(lower(url), 'icon') OR contains(lower(url), 'logo') OR contains(lower(url), 'avatar') AS decorative
       FROM pages""",
)
def page_noise_and_media(spark, sf_dir):
    df = base.pages(spark, sf_dir, "page_id", "url")
    return df.select(
        "page_id",
        pr.is_page_noise(F.col("url"), ("spam", "pills", "/es/")).alias("noise"),
        pr.is_decorative(F.col("url"), F.lit(None).cast("string")).alias("decorative"),
    )


_GENERIC = ("disgusting", "worthless", "trash", "license")


@query(
    "generic_and_topic_lines",
    rf"""WITH {sql.lines()} SELECT doc_id, pos, {sql.contains_any("lower(line)", _GENERIC)} AS generic,
        length(line) BETWEEN 2 AND 16 AND NOT contains(lower(line), 'the') AND NOT regexp_matches(line, '[0-9]{{3,}}')
          AND NOT regexp_matches(line, '[/\\\[\]《》():]') AS topic,
        length(line) BETWEEN 2 AND 10 AND NOT contains(lower(line), 'the') AND NOT regexp_matches(line, '[0-9]{{3,}}')
          AND NOT regexp_matches(line, '[/\\\[\]《》():]') AS secondary_topic
        FROM lines""",
)
def generic_and_topic_lines(spark, sf_dir):
    df = lines_exploded(spark, sf_dir)
    return df.select(
        "doc_id",
        "pos",
        pr.is_generic(F.col("line"), _GENERIC).alias("generic"),
        pr.is_topic(F.col("line"), ("the",)).alias("topic"),
        pr.is_secondary_topic(F.col("line"), ("the",)).alias("secondary_topic"),
    )


_DEBUG = ("token =", "555-", "licensed", "gnu general")


@query(
    "debug_lines_removed",
    f"""WITH raw AS (SELECT doc_id, list_filter(string_split(text, chr(10)),
          lambda x: NOT {sql.contains_any("lower(x)", _DEBUG)}) AS xs FROM documents)
        SELECT doc_id, {sql.strip("array_to_string(list_transform(xs, lambda x: " + sql.rstrip("x") + "), chr(10))")} AS text FROM raw""",
)
def debug_lines_removed(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text")
    return df.select("doc_id", pr.strip_debug(F.col("text"), _DEBUG).alias("text"))


_GUIDE = ("Ler", "Of", "Die", "En ")


@query(
    "guidance_split",
    f"""WITH {sql.REQUESTS}, c AS (SELECT doc_id, source_kind, source_url, {sql.strip("text")} AS v, {sql.squash("text")} AS compact FROM requests),
        g AS (SELECT *, source_kind IN ('video_url', 'url', 'mixed') AND source_url IS NOT NULL AS with_url,
          (length(compact) <= 120 AND {sql.contains_any("compact", _GUIDE)}) OR
          (length(compact) <= 90 AND contains(lower(compact), 'the')) AS guides FROM c)
        SELECT doc_id, CASE WHEN NOT with_url THEN v WHEN guides THEN '' ELSE compact END AS evidence,
          CASE WHEN with_url AND guides THEN compact ELSE '' END AS guidance FROM g""",
)
def guidance_split(spark, sf_dir):
    df = base.requests(spark, sf_dir)
    parts = pr.split_guidance(F.col("text"), F.col("source_kind"), F.col("source_url"), _GUIDE, ("the",))
    return df.select("doc_id", parts.alias("p")).select("doc_id", "p.evidence", "p.guidance")


@query(
    "raw_bullets",
    r"""WITH x AS (SELECT conv_id, turn, text, lower(trim(text)) AS p0, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
        y AS (SELECT *, CASE WHEN contains(substr(p0, 1, 4), '. ') THEN substr(p0, instr(p0, '. ') + 2) ELSE p0 END AS point FROM x)
        SELECT conv_id, turn, length(point) >= 90 OR (NOT regexp_matches(point, '[，。；：:,]')
          AND length(regexp_replace(point, '\s+', '', 'g')) >= 32
          AND contains(regexp_replace(lower(coalesce(before, '')), '\s+', '', 'g'), regexp_replace(point, '\s+', '', 'g'))) AS raw_bullet
        FROM y""",
)
def raw_bullets(spark, sf_dir):
    df = base.read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    # The turn before, by a join on (conversation, turn): no conversation meets in one task.
    earlier = df.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    df = df.join(earlier, ["conv_id", "turn"], "left")
    return df.select("conv_id", "turn", pr.is_raw_bullet(F.col("text"), F.col("before")).alias("raw_bullet"))


# --- scalar functions ---------------------------------------------------------


_PLAIN_HTML = (
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), "
    r"'(?is)<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
)


@query("page_plain_text", f"SELECT page_id, {sql.squash(_PLAIN_HTML)} AS plain FROM pages")
def page_plain_text(spark, sf_dir):
    df = base.pages(spark, sf_dir, "page_id", "html")
    return df.select("page_id", tx.strip_html(F.col("html")).alias("plain"))


@query(
    "page_title",
    rf"""WITH t AS (SELECT page_id, {sql.squash("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')")} AS t FROM pages)
       SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS title FROM t""",
)
def page_title(spark, sf_dir):
    df = base.pages(spark, sf_dir, "page_id", "html")
    return df.select("page_id", tx.page_title(F.col("html")).alias("title"))


_MD = "trim(line, ' ')"
for _p, _r in ((r"^#{1,6}\s*", ""), (r"^>\s*", ""), (r"^\d+\.\s+", ""), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("`", "")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_r}', 'g')"


@query(
    "markdown_lines",
    f"WITH {sql.lines()} SELECT doc_id, pos, {sql.squash('trim(' + _MD + ', ' + sql.lit(' -*' + chr(9)) + ')')} AS plain FROM lines",
)
def markdown_lines(spark, sf_dir):
    df = lines_exploded(spark, sf_dir)
    return df.select("doc_id", "pos", tx.markdown_line(F.col("line")).alias("plain"))


@query(
    "bullet_forms",
    f"""WITH {sql.lines()}, b AS (SELECT doc_id, pos, line, trim({sql.squash("line")}, '。；;') AS v FROM lines)
        SELECT doc_id, pos, {sql.clip("v", 120)} AS bullet,
          CASE WHEN contains(line, ':') THEN CASE WHEN length(trim(split_part(line, ':', 1))) <= 8
               THEN trim(substr(line, instr(line, ':') + 1)) ELSE line END ELSE line END AS fact,
          {sql.strip("substr(regexp_replace(lower(line), '[^0-9a-z]+', '-', 'g'), 1, 1)", "-")} AS first_slug_char
        FROM b""",
)
def bullet_forms(spark, sf_dir):
    df = lines_exploded(spark, sf_dir)
    line = F.col("line")
    return df.select(
        "doc_id",
        "pos",
        tx.normalize_bullet(line).alias("bullet"),
        tx.strip_fact_label(line).alias("fact"),
        tx.strip(F.substring(F.regexp_replace(F.lower(line), "[^0-9a-z]+", "-"), 1, 1), "-").alias("first_slug_char"),
    )


@query(
    "first_sentences",
    f"""WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({sql.squash("text")}, '[。！？!?]'),
          lambda p: {sql.strip("p")}), lambda p: p <> '') AS ps, {sql.strip("text")} AS whole FROM documents)
        SELECT doc_id, coalesce(ps[1], whole) AS sentence FROM x""",
)
def first_sentences(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text")
    return df.select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


_SAFE = r"""substr(trim(regexp_replace(url, '[\\/:*?"<>|]+', '-', 'g')), 1, 120)"""


@query(
    "safe_names",
    rf"""SELECT page_id, {_SAFE} AS safe_name,
        substr(trim(regexp_replace(lower(trim(url)), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '-', 'g'), '-'), 1, 48) AS slug,
        sha1(url) AS url_key, substr(sha1(url), 1, 12) AS short_key,
        'auto-' || substr(trim(regexp_replace(lower(trim(url)), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '-', 'g'), '-'), 1, 48)
          || '-' || substr(sha1('url|' || url || '|'), 1, 8) AS case_id
        FROM pages""",
)
def safe_names(spark, sf_dir):
    from gleaner.operators import cases

    df = base.pages(spark, sf_dir, "page_id", "url")
    u = F.col("url")
    return df.select(
        "page_id",
        tx.safe_name(u).alias("safe_name"),
        tx.slugify(u).alias("slug"),
        F.sha1(u).alias("url_key"),
        F.substring(F.sha1(u), 1, 12).alias("short_key"),
        cases.case_id(F.lit("url"), u, F.lit(""), F.lit("unknown")).alias("case_id"),
    )


@query(
    "token_cost",
    r"""WITH t AS (SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS n FROM documents),
        e AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(floor(n * 1.05::DOUBLE) AS BIGINT)) END AS tokens FROM t)
        SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, round(tokens / 1000000.0::DOUBLE * 0.15::DOUBLE + 900 / 1000000.0::DOUBLE * 0.6::DOUBLE, 6) AS cost_usd FROM e""",
)
def token_cost(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text")
    df = df.select("doc_id", sc.token_estimate(F.col("text")).alias("tokens"))
    cost = sc.call_cost_usd(F.col("tokens"), F.lit(900), 0.15, 0.60)
    return df.select("doc_id", "tokens", F.round(cost, 6).alias("cost_usd"))


@query(
    "clock_labels",
    """WITH s AS (SELECT event_id, ts, CAST(floor(value * 60) AS BIGINT) AS s FROM events)
        SELECT event_id, s AS seconds,
          CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
               ELSE printf('%02d:%02d', s // 60, s % 60) END AS label,
          CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || '小时' ELSE '' END
            || CASE WHEN s % 3600 // 60 > 0 THEN CAST(s % 3600 // 60 AS VARCHAR) || '分' ELSE '' END
            || CASE WHEN s % 60 > 0 OR s = 0 THEN CAST(s % 60 AS VARCHAR) || '秒' ELSE '' END AS words,
          CASE WHEN s > 0 THEN CAST(s AS DOUBLE) END AS back,
          strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso
        FROM s""",
)
def clock_labels(spark, sf_dir):
    df = base.read_table(spark, sf_dir, "events", "event_id", "ts", "value")
    s = F.floor(F.col("value") * 60).cast("long")
    df = df.select("event_id", "ts", s.alias("seconds"))
    return df.select(
        "event_id",
        "seconds",
        tm.clock_label(F.col("seconds")).alias("label"),
        tm.duration_words(F.col("seconds")).alias("words"),
        tm.parse_duration(F.concat(F.col("seconds").cast("string"), F.lit("s"))).alias("back"),
        tm.iso_utc(F.col("ts")).alias("iso"),
    )


@query(
    "max_clock_of_text",
    r"""WITH d AS (SELECT user_id, strftime(ts, '%H:%M:%S') AS clock FROM events),
        a AS (SELECT user_id, max(CAST(split_part(clock, ':', 1) AS INT) * 3600 + CAST(split_part(clock, ':', 2) AS INT) * 60
              + CAST(split_part(clock, ':', 3) AS INT)) AS top FROM d GROUP BY user_id)
        SELECT user_id, CAST(top AS DOUBLE) AS max_seconds FROM a WHERE top > 0""",
)
def max_clock_of_text(spark, sf_dir):
    """Largest clock over many texts: each text first, then a partial maximum."""
    df = base.read_table(spark, sf_dir, "events", "user_id", "ts")
    text = F.concat(F.lit("at "), F.date_format("ts", "HH:mm:ss"), F.lit(" seen"))
    df = df.select("user_id", tm.max_clock(text).alias("s"))
    return df.groupBy("user_id").agg(F.max("s").alias("max_seconds")).filter("max_seconds IS NOT NULL")


@query(
    "enum_normalised",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'view' END AS kind,
          CASE WHEN event_type IN ('error') THEN event_type ELSE 'ok' END AS level FROM events""",
)
def enum_normalised(spark, sf_dir):
    df = base.read_table(spark, sf_dir, "events", "event_id", "event_type")
    upper = F.concat(F.lit(" "), F.upper("event_type"))
    return df.select(
        "event_id",
        tx.choose(upper, ("click", "view"), "view").alias("kind"),
        tx.choose(upper, ("error",), "ok").alias("level"),
    )


@query(
    "json_field_fallback",
    """SELECT event_id, coalesce(json_extract_string(props, '$.text'), json_extract_string(props, '$.k')) AS value,
        CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS duration FROM events""",
)
def json_field_fallback(spark, sf_dir):
    df = base.read_table(spark, sf_dir, "events", "event_id", "props")
    parsed = F.from_json("props", "text STRING, k STRING")
    df = df.select("event_id", parsed.alias("p"))
    return df.select(
        "event_id",
        F.coalesce("p.text", "p.k").alias("value"),
        tm.parse_duration(F.col("p.k")).alias("duration"),
    )


_STOP = ("the", "and", "of")


@query(
    "query_tokens",
    rf"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._-]{{1,}}') AS ws FROM benchmark),
        u AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
        f AS (SELECT item_id, w, min(i) AS i FROM u WHERE lower(w) NOT IN ('the', 'and', 'of') GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM f)
        SELECT item_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM r GROUP BY item_id""",
)
def query_tokens(spark, sf_dir):
    from gleaner.operators import search

    df = base.read_table(spark, sf_dir, "benchmark")
    return df.select("item_id", F.array_join(search.query_tokens(F.col("text"), stop=_STOP), " ").alias("tokens"))


@query(
    "array_first_wins",
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
        u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
        f AS (SELECT doc_id, trim(w) AS w, min(i) AS i FROM u WHERE trim(w, chr(10) || ' ') <> '' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
        SELECT doc_id, string_agg(w, '|' ORDER BY i) AS first_words FROM r WHERE rn <= 12 GROUP BY doc_id""",
)
def array_first_wins(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text")
    words = ar.keep_first(F.split("text", " "), 12)
    return df.select("doc_id", F.array_join(words, "|").alias("first_words"))


@query(
    "evidence_fingerprint",
    rf"""WITH {sql.REQUESTS} SELECT doc_id, min(doc_id) OVER (PARTITION BY source_kind, {sql.squash("regexp_replace(text, '^https?://[^ ' || chr(10) || ']*' || chr(10), '')")}) AS first_doc FROM requests""",
)
def evidence_fingerprint(spark, sf_dir):
    """First document with the same fingerprint: equal content, and only that, shares one."""
    from gleaner.operators import evidence

    df = base.requests(spark, sf_dir)
    df = df.select(
        "doc_id", F.lit(None).cast("string").alias("source_url"), F.col("source_kind").alias("evidence_type"), F.lit("full").alias("coverage"),
        F.regexp_replace("text", r"^https?://[^ \n]*\n", "").alias("text"), F.lit("").alias("transcript"), F.lit(None).cast("string").alias("tracks"),
    )
    df = df.select("doc_id", evidence.fingerprint().alias("fp"))
    firsts = df.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    return salted_lookup(df, firsts, ["fp"], "inner").select("doc_id", "first_doc")


@query(
    "item_flags",
    f"""WITH {sql.REQUESTS} SELECT doc_id,
        source_kind = 'video_url' OR {sql.contains_any("lower(text)", ("licensed", "token"))} OR contains(lower(coalesce(source_url, '')), 'cloud.tencent.com/developer/article') AS tutorial,
        {sql.contains_any("lower(text)", ("gateway", "trash"))} AS installs,
        source_kind = 'video_url' OR contains(lower(coalesce(source_url, '')), '/fr/') AS video,
        source_url IS NOT NULL AND NOT (source_kind = 'video_url' AND doc_id % 3 = 0) AS cacheable,
        CASE WHEN doc_id % 2 = 0 THEN 'group_chat' ELSE 'direct_chat' END AS chat_target, source_url IS NOT NULL AS has_url
        FROM requests""",
)
def item_flags(spark, sf_dir):
    df = base.requests(spark, sf_dir)
    profile = F.when(F.col("source_kind") == "video_url", "installation_tutorial").otherwise("general_capture")
    no = F.lit(False)
    gate = F.when(F.col("doc_id") % 3 == 0, ar.strings("short")).otherwise(ar.empty_strings())
    chat = F.when(F.col("doc_id") % 2 == 0, F.lit(" -100")).otherwise(F.lit("100"))
    context = pr.entry_context(
        chat, F.lit(""), F.lit(""), F.col("source_kind"), F.col("source_url"), F.col("text"), ar.empty_strings()
    )
    return df.select(
        "doc_id",
        pr.is_tutorial(profile, F.col("text"), F.col("source_url"), no, no, ("licensed", "token")).alias("tutorial"),
        pr.is_install(F.col("text"), tokens=("gateway", "trash")).alias("installs"),
        pr.is_video(F.col("source_kind"), F.col("source_url"), ("/fr/",)).alias("video"),
        pr.cache_eligible(F.col("source_url"), F.col("source_kind"), gate, no).alias("cacheable"),
        context["chat_target"].alias("chat_target"),
        context["has_source_url"].alias("has_url"),
    )


@query(
    "segments_normalized",
    f"""WITH s AS (SELECT conv_id, turn, turn * 7.5 AS start, {sql.squash("text")} AS text FROM conversations WHERE turn * 7.5 < 40),
        f AS (SELECT conv_id, text, min(turn) AS ord, arg_min(start, turn) AS start FROM s WHERE text <> '' GROUP BY conv_id, text)
        SELECT conv_id, ord, CAST(start AS DOUBLE) AS start, text FROM f""",
)
def segments_normalized(spark, sf_dir):
    """Turns as transcript segments of 7.5 seconds with a horizon."""
    from gleaner.operators import segments

    df = base.read_table(spark, sf_dir, "conversations")
    start = F.col("turn") * 7.5
    rows = df.select("conv_id", F.col("turn").alias("ord"), start.alias("start"), (start + 7.5).alias("end"), "text")
    return segments.normalize_segment_rows(rows, "conv_id", 40.0).select("conv_id", "ord", "start", "text")
