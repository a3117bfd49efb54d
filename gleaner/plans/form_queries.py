"""URL, command, skill and note forms on values that the event table makes up."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import notes
from gleaner.operators import predicates as pr
from gleaner.plans import base
from gleaner.plans.registry import query


def _events(spark, sf_dir):
    return base.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")


_VIDEO = "'BV1' || lpad(CAST(user_id AS VARCHAR), 9, 'x')"


@query(
    "platform_urls",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'https://www.bilibili.com/video/' || {_VIDEO} WHEN 'click' THEN 'https://www.bilibili.com/bangumi/' || user_id
        ELSE 'https://e.com/video/' || {_VIDEO} END AS url FROM events""",
)
def platform_urls(spark, sf_dir):
    """Video pages with ids in several places, a video site without an id, and an id elsewhere."""
    df = _events(spark, sf_dir)
    video = F.concat(F.lit("BV1"), F.lpad(F.col("user_id").cast("string"), 9, "x"))
    url = F.when(F.col("event_type") == "view", F.when(F.col("value") > 20, F.concat(F.lit("https://m.bilibili.com/video/"), video, F.lit("?p=2&t=1")))
                 .otherwise(F.concat(F.lit("https://b23.tv/x?to="), video)))
    url = url.when(F.col("event_type") == "click", F.concat(F.lit("https://www.bilibili.com/bangumi/"), "user_id")).otherwise(F.concat(F.lit("https://e.com/video/"), video))
    return df.select("event_id", urls.platform_url(url).alias("url"))


@query(
    "code_host_urls",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'owner' || user_id || '/repo.' || event_type END AS repo,
        CASE WHEN event_type = 'click' THEN 'v' || event_id || ':docs/' || user_id || '/README.md' END AS blob,
        CASE event_type WHEN 'purchase' THEN 'web' WHEN 'error' THEN 'youtube' ELSE 'github' END AS family FROM events""",
)
def code_host_urls(spark, sf_dir):
    """Repository and file of code-host URLs: pages, files, clone addresses, and what is neither."""
    df = _events(spark, sf_dir)
    root = F.concat(F.lit("https://github.com/owner"), "user_id", F.lit("/repo."), "event_type")
    kind = F.col("event_type")
    url = F.when(kind == "view", F.concat(root, F.lit("/issues/3?x=1"))).when(
        kind == "click", F.concat(root, F.lit("/blob/v"), "event_id", F.lit("/docs/"), "user_id", F.lit("/README.md"))
    ).when(kind == "signup", F.concat(root, F.lit(".git"))).when(kind == "error", F.concat(F.lit("https://youtu.be/"), "user_id")).otherwise(
        F.concat(F.lit("https://e.com/owner/"), "user_id"))
    df = df.select("event_id", url.alias("url")).withColumn("b", urls.blob_of(F.col("url")))
    blob = F.concat("b.branch", F.lit(":"), "b.path")
    return df.select("event_id", urls.repo_of(F.col("url")).alias("repo"), blob.alias("blob"), urls.family(F.col("url")).alias("family"))


@query(
    "command_forms",
    """SELECT event_id, 'pip install pkg' || user_id AS command, substr('name ' || event_type || ' ' || repeat('x', user_id % 60 + 1), 1, 40) AS skill,
        event_type IN ('view', 'click', 'signup') AS noisy FROM events""",
)
def command_forms(spark, sf_dir):
    """Commands before CJK text and punctuation, skill names with quotes and long ones, and names that are no skill."""
    df = _events(spark, sf_dir)
    command = F.concat(F.lit("  pip install pkg"), "user_id", F.when(F.col("value") > 20, F.lit("；。 然后运行 x")).otherwise(F.lit(";:")))
    skill = F.concat(F.lit(" 「name」  "), "event_type", F.lit("\n"), F.repeat(F.lit("x"), (F.col("user_id") % 60 + 1).cast("int")), F.lit("。"))
    kind = F.col("event_type")
    name = F.when(kind == "view", F.concat(F.lit("Install-x"), "user_id")).when(kind == "click", F.concat(F.lit("a.b-"), "user_id", F.lit(" SKILL"))).when(
        kind == "signup", F.concat(F.lit("please INSTALL "), "user_id")).when(
        kind == "error", F.concat(F.lit("how to install 分析 "), "user_id")).otherwise(F.lit("data analysis"))
    return df.select("event_id", tx.normalize_command(command).alias("command"), tx.clean_skill_name(skill).alias("skill"), pr.is_noisy_skill(name).alias("noisy"))


@query(
    "note_links",
    """SELECT event_id, '[[Root/' || CASE event_type WHEN 'view' THEN 'a/t' || user_id || '/t' || user_id || ' Index.md' ELSE 'a/t' || user_id || '.md' END || ']]' AS link,
        'obsidian://open?vault=My%20Vault&file=in%20box/' || user_id || '%26x.md' AS uri FROM events""",
)
def note_links(spark, sf_dir):
    """Wiki links of index notes and deep links with escapes."""
    df = _events(spark, sf_dir)
    target = F.concat(F.lit("a/t"), "user_id")
    kind = F.when(F.col("event_type") == "view", "topic").otherwise("entity")
    return df.select("event_id", notes.link_target("Root", kind, target).alias("link"), notes.note_uri("My Vault", F.concat(F.lit("in box/"), "user_id", F.lit("&x.md"))).alias("uri"))
