"""Notes: keywords, tags, edges, topic selection, indexes and vault clean-up.

Indexes are edge rows (topic, note). A topic may hold a third of all notes, so no
index is ever collected into one row; it is written sorted by range instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import predicates as pr
from gleaner.operators.keyed import salted_lookup, top_per_key
from gleaner.operators.lines import first_by_key

#: Names worth a keyword when a title holds them.
TITLE_NAMES = (r"(杀戮尖塔\d?)", "(Claudian)", "(Trading Agents)", "(OpenRAG)", r"(DCS\d+[A-Z]?)", "(0day)", "(Obsidian)")


def keyword(c: Column) -> Column:
    return tx.strip(tx.squash(tx.text_or_empty(c)), "#[]()")


def is_keyword(c: Column, generic: Iterable[str] = lx.GENERIC_TOPICS) -> Column:
    return F.length(c).between(2, 36) & ~c.isin(*generic) & ~tx.starts_any(c, ("http://", "https://"))


def category(corpus: Column, rules: Sequence[tuple[str, Sequence[str]]] = lx.KEYWORD_CATEGORIES) -> Column:
    """First category with a token in the lower-cased corpus; short ASCII tokens match whole words only."""

    def hit(tokens: Sequence[str]) -> Column:
        low = [t.lower() for t in tokens]
        short = [t for t in low if len(t) <= 4 and t.isascii() and all(ch.isalnum() or ch in ".+_-" for ch in t)]
        long_ones = [t for t in low if t not in short]
        test = tx.contains_any(corpus, long_ones)
        if short:
            test = test | corpus.rlike(rf"(?U)\b{tx.alternation(short)}\b")
        return test

    return F.coalesce(*[F.when(hit(tokens), F.lit(label)) for label, tokens in rules])


def keyword_hierarchy(df: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = lx.KEYWORD_CATEGORIES, out: str = "keywords") -> DataFrame:
    """Add struct(l1, l2): one main keyword and up to four secondary ones.

    Expects ``title, primary_topic, secondary_topics, entities, note_tags,
    conclusion, bullets, evidence_title, text, signals, platform_tags``.
    """
    s = F.col("signals")
    tags = ar.or_empty(F.col("platform_tags"))
    several = F.concat(
        F.array("title", "primary_topic"), ar.or_empty(F.col("secondary_topics")), ar.or_empty(F.col("entities")),
        ar.or_empty(F.col("note_tags")), F.array("conclusion"), ar.or_empty(F.col("bullets")), F.array("evidence_title", "text"),
        *[ar.take(s[k], 6) for k in ("skills", "skill_ids", "projects", "hashtags")], ar.take(tags, 8),
    )
    corpus = F.lower(F.array_join(F.filter(F.transform(several, keyword), lambda x: x != ""), "\n"))
    df = df.withColumn("_corpus", corpus)

    def usable(arr: Column) -> Column:
        return F.filter(F.transform(arr, keyword), lambda x: is_keyword(x))

    topics = [F.array("primary_topic"), ar.or_empty(F.col("secondary_topics")), ar.or_empty(F.col("entities"))]
    first = usable(F.concat(*topics, ar.take(s["skills"], 2), ar.take(s["projects"], 1)))
    l1 = F.coalesce(category(F.col("_corpus"), rules), F.try_element_at(first, F.lit(1)))
    title = keyword(F.coalesce(F.nullif(F.col("evidence_title"), F.lit("")), F.col("title")))
    named = F.array(*[F.nullif(F.regexp_extract(title, f"(?i){p}", 1), F.lit("")) for p in TITLE_NAMES])
    candidates = F.concat(
        usable(F.concat(*topics[1:], ar.or_empty(F.col("note_tags")), tags)),
        usable(F.concat(ar.take(s["skills"], 3), ar.take(s["skill_ids"], 3), ar.take(s["projects"], 2))),
        F.transform(F.array_compact(named), keyword),
    )
    df = df.withColumn("_l1", l1)
    l2 = F.filter(candidates, lambda x: ~x.eqNullSafe(F.col("_l1")))
    result = F.struct(F.col("_l1").alias("l1"), ar.take(F.array_distinct(l2), 4).alias("l2"))
    return df.withColumn(out, result).drop("_corpus", "_l1")


def note_tags(tags: Column, l1: Column, l2: Column) -> Column:
    """Tags and keywords, first spelling of each, order kept."""
    everything = F.concat(ar.or_empty(tags), F.array(tx.text_or_empty(l1)), ar.or_empty(l2))
    cleaned = F.filter(F.transform(everything, lambda x: tx.squash(x)), lambda x: x != "")
    return first_by_key(cleaned, lambda x: F.lower(x))


def unique_topics(primary: Column, secondary: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(F.array(primary), ar.or_empty(secondary)), lambda x: tx.text_or_empty(x) != ""))


def topic_edges(notes: DataFrame, note: str = "note") -> DataFrame:
    """(note, topic, ord, is_primary) rows."""
    topics = unique_topics(F.col("primary_topic"), F.col("secondary_topics"))
    return ar.explode_rows(notes, note, topics, "topic").select(
        note, "topic", "ord", (F.col("ord") == 0).alias("is_primary")
    )


def topic_counts(index: DataFrame) -> DataFrame:
    """Notes per topic."""
    return index.groupBy("topic").agg(F.count("*").alias("n_notes"))


def select_topics(
    edges: DataFrame, counts: DataFrame, whitelist: Sequence[str] = (), blocklist: Sequence[str] = (), limit: int = 3, note: str = "note",
    min_secondary: int = 2,
) -> DataFrame:
    """Topics a note is linked to: allow-listed, or known to enough notes already.

    The counts have one row per topic; hot topics on the edge side are dealt over
    salts, so the join holds for any vocabulary size.
    """
    reasonable = edges.filter(pr.is_topic(F.col("topic"), blocklist))
    counted = salted_lookup(reasonable, counts, ["topic"], "left", deal_by=[note])
    n = F.coalesce("n_notes", F.lit(0))
    listed = F.col("topic").isin(*whitelist) if whitelist else F.lit(False)
    primary = F.col("is_primary") & (n >= 1)
    secondary = ~F.col("is_primary") & pr.is_secondary_topic(F.col("topic"), blocklist) & (n >= min_secondary)
    chosen = counted.filter(listed | primary | secondary)
    return top_per_key(chosen, [note], [F.col("ord").asc()], limit).select(note, "topic", "ord")


def skipped_topics(unique: Column, linked: Column) -> Column:
    return F.array_except(unique, linked)


def note_edges(notes: DataFrame, note: str = "note") -> DataFrame:
    """note -> topic, keyword and entity edges with path-safe targets.

    Expects ``linked_topics, keywords`` (struct l1, l2) and ``entities``.
    """
    l1, l2 = F.col("keywords.l1"), F.col("keywords.l2")

    def typed(kind: str, arr: Column) -> Column:
        return F.transform(ar.or_empty(arr), lambda x: F.struct(F.lit(kind).alias("kind"), tx.safe_name(x).alias("target")))

    under = F.transform(l2, lambda x: F.concat(tx.safe_name(l1), F.lit("/"), tx.safe_name(x)))
    pairs = F.concat(
        typed("topic", F.col("linked_topics")),
        typed("keyword_l1", F.array_compact(F.array(l1))),
        F.transform(F.when(l1.isNotNull(), under).otherwise(ar.empty_strings()),
                    lambda x: F.struct(F.lit("keyword_l2").alias("kind"), x.alias("target"))),
        typed("entity", F.col("entities")),
    )
    return ar.explode_rows(notes, note, F.array_distinct(pairs), "e").select(note, "e.kind", "e.target")


def link_target(root: Column | str, kind: Column, target: Column) -> Column:
    """Wiki link of an index document."""
    base = F.lit(root) if isinstance(root, str) else root
    last = F.element_at(F.split(target, "/"), -1)
    path = F.when(kind.isin("topic", "keyword_l1"), F.concat(target, F.lit("/"), last, F.lit(" Index.md"))).otherwise(
        F.concat(target, F.lit(".md"))
    )
    return F.concat(F.lit("[["), base, F.lit("/"), path, F.lit("]]"))


def note_uri(vault: Column | str, path: Column, scheme: str = "obsidian") -> Column:
    """Deep link that opens a note."""
    name = F.lit(vault) if isinstance(vault, str) else vault
    return F.concat(
        F.lit(f"{scheme}://open?vault="), tx.percent_encode(name), F.lit("&file="), tx.percent_encode(path, keep_slash=True)
    )


def index_rows(edges: DataFrame, note: str = "note") -> DataFrame:
    """Distinct (topic, note) rows, ready to be written sorted."""
    return edges.select("topic", note).distinct()


def without_stale(index: DataFrame, rewritten: DataFrame, note: str = "note") -> DataFrame:
    """Index rows whose note was not rewritten; topics left without notes vanish by themselves."""
    return index.join(rewritten.select(note).distinct(), note, "left_anti")


def foreign_topics(index: DataFrame, root: str, note: str = "note") -> DataFrame:
    """Topics whose index also lists notes from elsewhere; clean-up leaves these alone."""
    return index.filter(~F.startswith(F.col(note), F.lit(root + "/"))).select("topic").distinct()


def refresh_index(index: DataFrame, edges: DataFrame, root: str, note: str = "note") -> DataFrame:
    """New index: desired edges plus every row of a topic with foreign links."""
    kept = index.join(foreign_topics(index, root, note), "topic", "left_semi")
    wanted = index_rows(edges, note).join(foreign_topics(index, root, note), "topic", "left_anti")
    return kept.select("topic", note).unionByName(wanted).distinct()


def index_actions(index: DataFrame, edges: DataFrame, root: str, note: str = "note") -> DataFrame:
    """(topic, action, n_notes): update, create, remove or keep (foreign links)."""
    have = index.groupBy("topic").agg(
        F.count("*").alias("n_have"), F.bool_or(~F.startswith(F.col(note), F.lit(root + "/"))).alias("foreign")
    )
    want = index_rows(edges, note).groupBy("topic").agg(F.count("*").alias("n_want"))
    both = have.join(want, "topic", "full")
    action = (
        F.when(F.col("n_have").isNull(), F.lit("create"))
        .when(F.col("foreign"), F.lit("keep"))
        .when(F.col("n_want").isNull(), F.lit("remove"))
        .otherwise(F.lit("update"))
    )
    return both.select("topic", action.alias("action"), F.coalesce("n_want", F.lit(0).cast("long")).alias("n_notes"))


def duplicate_notes(notes: DataFrame, path: str = "path") -> DataFrame:
    """(path, keep): notes that repeat another by URL, or by title and evidence.

    The kept path of a group is a maximum, so groups shrink before the shuffle;
    the members of a large group then find it through a salted join.
    """
    url, title, body = (tx.strip(tx.text_or_empty(F.col(c))) for c in ("source_url", "title", "raw_evidence"))
    key = F.when(url != "", F.concat(F.lit("u:"), url)).when(
        body != "", F.concat(F.lit("c:"), F.sha2(F.concat_ws("\x00", title, body), 256))
    )
    keyed = notes.select(F.col(path), key.alias("key")).filter("key IS NOT NULL")
    groups = keyed.groupBy("key").agg(F.max(path).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    members = salted_lookup(keyed, groups.select("key", "keep"), ["key"], "inner", deal_by=[path])
    return members.filter(F.col(path) != F.col("keep")).select(path, "keep")


def dedup_notes(notes: DataFrame, path: str = "path") -> DataFrame:
    """Notes without the repeated ones."""
    return notes.join(duplicate_notes(notes, path).select(path), path, "left_anti")


class Vault(NamedTuple):
    notes: DataFrame
    index: DataFrame


def rebuild_vault(notes: DataFrame, index: DataFrame, root: str) -> Vault:
    """Drop repeated notes, then renew the topic index from what is left.

    Expects notes as made by ``sources.readers.parse_notes``.
    """
    kept = dedup_notes(notes)
    edges = ar.explode_rows(kept.withColumnRenamed("path", "note"), "note", F.col("topic_names"), "topic")
    return Vault(kept, refresh_index(index, edges, root))


def existing_note(items: DataFrame, notes: DataFrame, url: str = "source_url") -> DataFrame:
    """Add ``note_path``: the latest note with the same canonical URL."""
    latest = (
        notes.select(urls.canonical_url(F.col(url)).alias("_key"), "path").filter("_key <> ''").groupBy("_key").agg(F.max("path").alias("note_path"))
    )
    keyed = items.withColumn("_key", urls.canonical_url(F.col(url)))
    return salted_lookup(keyed, latest, ["_key"], "left").drop("_key")


def note_path(title: Column, captured_at: Column, root: str, existing: Column | None = None) -> Column:
    """``root/YYYY/MM/date time title.md``, or the path of the existing note."""
    name = tx.safe_name(F.concat_ws(" ", F.date_format(captured_at, "yyyy-MM-dd HHmm"), title))
    fresh = F.concat(F.lit(root + "/"), F.date_format(captured_at, "yyyy/MM"), F.lit("/"), name, F.lit(".md"))
    return F.coalesce(existing, fresh) if existing is not None else fresh
