"""Note, index, registry and job queries.

Documents stand in for notes: the source is the main topic, the language a second
one, and exact copies of a text are duplicates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import arrays as ar
from gleaner.functions import urls
from gleaner.operators import cases, notes
from gleaner.operators import predicates as pr
from gleaner.plans import base, sql
from gleaner.plans.registry import query
from gleaner.session import run_folder
from gleaner.sources import versions
from gleaner.streaming import ledger

_NOTES = """notes AS (
      SELECT d.doc_id, 'Inbox/' || printf('%08d', d.doc_id) || '.md' AS note, d.source AS primary_topic, d.lang AS secondary,
             p.url AS source_url, split_part(d.text, chr(10), 1) AS title, d.text AS raw_evidence
      FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def note_table(spark, sf_dir):
    docs = base.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    links = base.read_table(spark, sf_dir, "pages", F.col("page_id").alias("doc_id"), F.col("url").alias("source_url"))
    df = docs.join(links, "doc_id", "left")
    name = F.concat(F.lit("Inbox/"), F.format_string("%08d", F.col("doc_id")), F.lit(".md"))
    return df.select(
        "doc_id", name.alias("note"), F.col("source").alias("primary_topic"), F.array("lang").alias("secondary_topics"),
        "source_url", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("raw_evidence"),
    )


_EDGES = f"""{_NOTES}, edges AS (SELECT note, primary_topic AS topic, 0 AS ord, true AS is_primary FROM notes
      UNION ALL SELECT note, secondary, 1, false FROM notes WHERE secondary <> primary_topic)"""


@query("topic_edges", f"WITH {_EDGES} SELECT note, topic, ord, is_primary FROM edges")
def topic_edges(spark, sf_dir):
    return notes.topic_edges(note_table(spark, sf_dir))


@query("topic_index", f"WITH {_EDGES} SELECT DISTINCT topic, note FROM edges")
def topic_index(spark, sf_dir):
    return notes.index_rows(notes.topic_edges(note_table(spark, sf_dir)))


@query("topic_counts", f"WITH {_EDGES} SELECT topic, count(*) AS n_notes FROM edges GROUP BY topic")
def topic_counts(spark, sf_dir):
    return notes.topic_counts(notes.topic_edges(note_table(spark, sf_dir)))


@query(
    "topic_selection",
    f"""WITH {_EDGES}, c AS (SELECT topic, count(*) AS n FROM edges GROUP BY topic),
        s AS (SELECT e.*, c.n FROM edges e JOIN c USING (topic) WHERE length(topic) BETWEEN 2 AND 16 AND NOT contains(topic, 'src1')),
        k AS (SELECT * FROM s WHERE topic = 'src5' OR (is_primary AND n >= 1) OR (NOT is_primary AND n >= 150))
        SELECT note, topic, ord FROM k""",
)
def topic_selection(spark, sf_dir):
    edges = notes.topic_edges(note_table(spark, sf_dir))
    counts = notes.topic_counts(edges)
    return notes.select_topics(edges, counts, ("src5",), ("src1",), min_secondary=150)


@query(
    "stale_entries_anti_join",
    f"""WITH {_EDGES} SELECT topic, note FROM edges WHERE note NOT IN (SELECT note FROM notes JOIN labels USING (doc_id))""",
)
def stale_entries_anti_join(spark, sf_dir):
    table = note_table(spark, sf_dir)
    index = notes.index_rows(notes.topic_edges(table))
    rewritten = table.join(base.read_table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")
    return notes.without_stale(index, rewritten)


_OLD = """old AS (SELECT topic, note FROM edges WHERE CAST(regexp_extract(note, '([0-9]+)', 1) AS BIGINT) % 3 = 0
      UNION ALL SELECT 'gone', note FROM edges WHERE topic = 'src3' UNION ALL SELECT 'src7', 'Else/x.md')"""


def _old_index(edges):
    number = F.regexp_extract("note", "([0-9]+)", 1).cast("long")
    old = edges.filter(number % 3 == 0).select("topic", "note")
    gone = edges.filter("topic = 'src3'").select(F.lit("gone").alias("topic"), "note")
    foreign = edges.filter("topic = 'src7'").agg(F.lit("src7").alias("topic"), F.lit("Else/x.md").alias("note"))
    return old.unionByName(gone).unionByName(foreign)


@query(
    "index_actions",
    f"""WITH {_EDGES}, {_OLD}, h AS (SELECT topic, bool_or(NOT starts_with(note, 'Inbox/')) AS foreign_links FROM old GROUP BY topic),
        w AS (SELECT topic, count(DISTINCT note) AS n FROM edges GROUP BY topic)
        SELECT coalesce(h.topic, w.topic) AS topic, CASE WHEN h.topic IS NULL THEN 'create' WHEN h.foreign_links THEN 'keep' WHEN w.n IS NULL THEN 'remove' ELSE 'update' END AS action,
          coalesce(w.n, 0) AS n_notes FROM h FULL JOIN w ON h.topic = w.topic""",
)
def index_actions(spark, sf_dir):
    edges = notes.topic_edges(note_table(spark, sf_dir))
    return notes.index_actions(_old_index(edges), edges, "Inbox")


@query(
    "index_refresh",
    f"""WITH {_EDGES}, {_OLD} SELECT DISTINCT topic, note FROM (SELECT topic, note FROM old WHERE topic = 'src7' UNION ALL SELECT topic, note FROM edges WHERE topic <> 'src7')""",
)
def index_refresh(spark, sf_dir):
    edges = notes.topic_edges(note_table(spark, sf_dir))
    return notes.refresh_index(_old_index(edges), edges, "Inbox")


_DUP = f"""{_NOTES}, k AS (SELECT note, CASE WHEN coalesce(trim(source_url), '') <> '' THEN 'u:' || split_part(source_url, '/', 3) ELSE 'c:' || title || raw_evidence END AS key FROM notes),
      g AS (SELECT key, max(note) AS keep FROM k GROUP BY key HAVING count(*) > 1)"""


@query("duplicate_notes", f"WITH {_DUP} SELECT k.note AS path, g.keep FROM k JOIN g USING (key) WHERE k.note <> g.keep")
def duplicate_notes(spark, sf_dir):
    """The host stands in for the URL, so that URL groups occur."""
    df = note_table(spark, sf_dir)
    df = df.select(F.col("note").alias("path"), urls.host(F.coalesce("source_url", F.lit(""))).alias("source_url"), "title", "raw_evidence")
    return notes.duplicate_notes(df)


@query("dedup_notes", f"WITH {_DUP} SELECT note AS path FROM k LEFT JOIN g USING (key) WHERE g.key IS NULL OR k.note = g.keep")
def dedup_notes(spark, sf_dir):
    df = note_table(spark, sf_dir)
    df = df.select(F.col("note").alias("path"), urls.host(F.coalesce("source_url", F.lit(""))).alias("source_url"), "title", "raw_evidence")
    return notes.dedup_notes(df).select("path")


@query(
    "existing_note",
    f"""WITH {_NOTES}, n AS (SELECT split_part(split_part(source_url, '#', 1), '?', 1) AS k, max(note) AS note_path FROM notes WHERE source_url IS NOT NULL GROUP BY 1)
        SELECT p.page_id, n.note_path FROM pages p LEFT JOIN n ON n.k = split_part(split_part(p.url, '#', 1), '?', 1)""",
)
def existing_note(spark, sf_dir):
    bare = F.substring_index(F.substring_index("source_url", "#", 1), "?", 1)
    table = note_table(spark, sf_dir).filter("source_url IS NOT NULL").select(bare.alias("source_url"), F.col("note").alias("path"))
    items = base.read_table(spark, sf_dir, "pages", "page_id", F.col("url").alias("source_url")).withColumn("source_url", bare)
    return notes.existing_note(items, table).select("page_id", "note_path")


_RULES = (("legal", ("license", "gnu")), ("secrets", ("token", "ssn")), ("abuse", ("stupid", "scum", "trash")), ("contact", ("@mail", "555-")), ("short", ("der", "ing")))


@query(
    "keyword_hierarchy",
    rf"""WITH c AS (SELECT doc_id, lang, source, lower({sql.squash("text")}) AS t FROM documents),
        k AS (SELECT *, lower(source) || chr(10) || lower(lang) || chr(10) || trim(t, '#[]()') AS corpus FROM c)
        SELECT doc_id, CASE WHEN contains(corpus, 'license') OR regexp_matches(corpus, '\bgnu\b') THEN 'legal' WHEN contains(corpus, 'token') OR regexp_matches(corpus, '\bssn\b') THEN 'secrets'
          WHEN contains(corpus, 'stupid') OR regexp_matches(corpus, '\bscum\b') OR contains(corpus, 'trash') THEN 'abuse' WHEN contains(corpus, '@mail') OR regexp_matches(corpus, '\b555-\b') THEN 'contact'
          WHEN regexp_matches(corpus, '\bder\b') OR regexp_matches(corpus, '\bing\b') THEN 'short' ELSE source END AS l1, lang AS l2 FROM k""",
)
def keyword_hierarchy(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    from gleaner import lexicons as lx

    none = ar.empty_strings()
    df = df.withColumns(
        {
            "title": F.lit(""), "primary_topic": F.col("source"), "secondary_topics": F.array("lang"), "entities": none, "note_tags": none,
            "conclusion": F.lit(""), "bullets": none, "evidence_title": F.lit(""), "platform_tags": none,
            "signals": F.struct(*[none.alias(k) for k in lx.SIGNAL_KINDS]),
        }
    )
    df = notes.keyword_hierarchy(df, _RULES)
    return df.select("doc_id", "keywords.l1", F.array_join("keywords.l2", ",").alias("l2"))


@query(
    "note_tags",
    f"""WITH {sql.lines()}, t AS (SELECT doc_id, line, pos FROM lines ),
        a AS (SELECT d.doc_id, coalesce((SELECT list(line ORDER BY pos) FROM t WHERE t.doc_id = d.doc_id), []) || [upper(d.lang), d.source, d.lang] AS tags FROM documents d),
        u AS (SELECT doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM a),
        f AS (SELECT doc_id, arg_min({sql.squash("tag")}, i) AS tag, min(i) AS i FROM u GROUP BY doc_id, lower({sql.squash("tag")}))
        SELECT doc_id, string_agg(tag, '|' ORDER BY i) AS tags FROM f GROUP BY doc_id""",
)
def note_tags(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return df.select(
        "doc_id", F.array_join(notes.note_tags(ar.lines(F.col("text")), F.upper("lang"), F.array("source", "lang")), "|").alias("tags")
    )


@query(
    "note_edges",
    f"""WITH {_NOTES}, l AS (SELECT n.note, n.primary_topic, n.secondary, l.quality FROM notes n LEFT JOIN labels l USING (doc_id))
        SELECT note, 'topic' AS kind, primary_topic AS target FROM l UNION ALL SELECT note, 'keyword_l1', secondary FROM l
        UNION ALL SELECT note, 'keyword_l2', secondary || '/' || primary_topic FROM l UNION ALL SELECT note, 'entity', 'q-' || quality FROM l WHERE quality IS NOT NULL""",
)
def note_edges(spark, sf_dir):
    df = note_table(spark, sf_dir).join(base.read_table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    lang = F.get("secondary_topics", F.lit(0))
    entity = F.when(F.col("quality").isNotNull(), F.array(F.concat(F.lit("q/"), F.col("quality").cast("string"))))
    df = df.select(
        "note", F.array("primary_topic").alias("linked_topics"),
        F.struct(lang.alias("l1"), F.array("primary_topic").alias("l2")).alias("keywords"), entity.alias("entities"),
    )
    return notes.note_edges(df)


@query(
    "note_paths",
    f"""WITH {_NOTES} SELECT n.note, 'Inbox/' || strftime(e.ts, '%Y/%m') || '/' || substr(trim(regexp_replace(strftime(e.ts, '%Y-%m-%d %H%M') || ' ' || n.title, '[\\/:*?"<>|]+', '-', 'g'), {sql.lit(" " + chr(10) + chr(9))}), 1, 120) || '.md' AS path
        FROM notes n JOIN events e ON e.event_id = n.doc_id""",
)
def note_paths(spark, sf_dir):
    stamps = base.read_table(spark, sf_dir, "events", F.col("event_id").alias("doc_id"), "ts")
    df = note_table(spark, sf_dir).join(stamps, "doc_id")
    return df.select("note", notes.note_path(F.col("title"), F.col("ts"), "Inbox").alias("path"))


@query(
    "skipped_topics",
    """SELECT doc_id, CASE WHEN lang <> 'en' AND source <> 'src2' THEN source || ',' || lang WHEN lang <> 'en' THEN lang WHEN source <> 'src2' THEN source ELSE '' END AS skipped FROM documents""",
)
def skipped_topics(spark, sf_dir):
    df = base.read_table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    unique = notes.unique_topics(F.col("source"), F.array("lang", "source"))
    return df.select("doc_id", F.array_join(notes.skipped_topics(unique, ar.strings("en", "src2")), ",").alias("skipped"))


@query(
    "checklist_kept",
    f"""SELECT doc_id, lang = 'de' OR {sql.contains_any("lower(text)", ("token", "licensed"))} AS keep FROM documents""",
)
def checklist_kept(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text", "lang")
    profile = F.when(F.col("lang") == "de", "installation_tutorial").otherwise("general_capture")
    keep = pr.keep_checklist(profile, ar.lines(F.col("text")), ("token", "licensed"))
    return df.select("doc_id", keep.alias("keep"))


# --- registry -------------------------------------------------------------------------------

_CASES = f"""c AS (SELECT d.doc_id AS ord, CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'url' ELSE 'video_url' END AS source_kind,
        {sql.squash("text")} AS body, CASE WHEN l.doc_id IS NOT NULL THEN 'manual' ELSE 'auto' END AS provenance, lang, source,
        CASE WHEN l.doc_id IS NULL THEN 'low_' || lang ELSE '' END AS auto_reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
      k AS (SELECT *, source_kind || '||' || body AS key, (CASE provenance WHEN 'manual' THEN 0 ELSE 1 END, ord) AS rk FROM c)"""


def case_tables(spark, sf_dir):
    docs = base.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labelled = base.read_table(spark, sf_dir, "labels", "doc_id").withColumn("has", F.lit(True))
    df = docs.join(labelled, "doc_id", "left")
    kind = F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "url").otherwise("video_url")
    manual = F.col("has").isNotNull()
    return df.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), kind.alias("source_kind"),
        F.lit("").alias("source_url"), F.col("text").alias("raw_text"), F.lit("").alias("platform_hint"),
        F.when(manual, "manual").otherwise("auto").alias("provenance"), F.array("lang", "source").alias("labels"),
        F.when(manual, F.lit("")).otherwise(F.concat(F.lit("low_"), "lang")).alias("auto_reason"),
    )


@query(
    "merged_cases",
    f"""WITH {_CASES}, w AS (SELECT key, arg_min(ord, rk) AS id, arg_min(provenance, rk) AS provenance, coalesce(arg_min(auto_reason, rk) FILTER (WHERE auto_reason <> ''), '') AS auto_reason FROM k GROUP BY key),
        ls AS (SELECT key, lang AS label, rk, 0 AS p FROM k UNION ALL SELECT key, source, rk, 1 FROM k),
        l AS (SELECT key, label, min((rk, p)) AS first_at FROM ls GROUP BY key, label),
        g AS (SELECT key, string_agg(label, ',' ORDER BY first_at) AS labels FROM l GROUP BY key)
        SELECT CAST(w.id AS VARCHAR) AS id, w.provenance, w.auto_reason, g.labels FROM w JOIN g USING (key)""",
)
def merged_cases(spark, sf_dir):
    table = case_tables(spark, sf_dir)
    merged = cases.merge_cases(table.filter("provenance = 'manual'"), table.filter("provenance = 'auto'"))
    return merged.select("id", "provenance", "auto_reason", F.array_join("labels", ",").alias("labels"))


@query(
    "new_auto_cases",
    f"""WITH {_CASES} SELECT DISTINCT sha1(key) AS case_sha, auto_reason FROM k WHERE provenance = 'auto'
        AND (key, auto_reason) NOT IN (SELECT (key, auto_reason) FROM k WHERE provenance = 'auto' AND ord IN (SELECT doc_id + 1 FROM labels))""",
)
def new_auto_cases(spark, sf_dir):
    """Automatic cases that the inbox, the documents behind a labelled one, does not hold yet."""
    inbox = base.read_table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("ord"))
    table = case_tables(spark, sf_dir).filter("provenance = 'auto'")
    digest = cases.case_digest(F.col("source_kind"), F.col("source_url"), F.col("raw_text"))
    keyed = table.select(digest.alias("case_digest"), "auto_reason", "ord")
    fresh = cases.new_case_ids(keyed, keyed.join(inbox, "ord", "left_semi"), "ord")
    return fresh.select(F.col("case_digest").alias("case_sha"), "auto_reason")


@query(
    "registry_delta",
    f"""WITH {_CASES}, w AS (SELECT key, arg_min(ord, rk) AS id, arg_min(provenance, rk) AS provenance, coalesce(arg_min(auto_reason, rk) FILTER (WHERE auto_reason <> ''), '') AS auto_reason FROM k GROUP BY key),
        ls AS (SELECT key, lang AS label, rk, 0 AS p FROM k UNION ALL SELECT key, source, rk, 1 FROM k),
        l AS (SELECT key, label, min((rk, p)) AS first_at FROM ls GROUP BY key, label),
        g AS (SELECT key, string_agg(label, ',' ORDER BY first_at) AS labels FROM l GROUP BY key)
        SELECT sha1(key) AS case_digest, CAST(w.id AS VARCHAR) AS id, w.provenance, w.auto_reason, g.labels FROM w JOIN g USING (key)""",
)
def registry_delta(spark, sf_dir):
    """A stored registry of the automatic cases, merged with a delta of the manual ones, then with itself."""
    table = case_tables(spark, sf_dir)
    path = f"{run_folder(spark, 'registry')}/cases"
    versions.write(cases.case_registry(table.filter("provenance = 'auto'")), path)
    stored = versions.read(spark, path)
    merged = cases.merge_registries(stored, cases.case_registry(table.filter("provenance = 'manual'")), stored)
    out = cases.registry_cases(merged)
    return out.select("case_digest", "id", "provenance", "auto_reason", F.array_join("labels", ",").alias("labels"))


@query(
    "cases_in_order",
    "SELECT doc_id, quality FROM labels ORDER BY CASE WHEN quality = 1 THEN 0 ELSE 1 END, CAST(doc_id AS VARCHAR) LIMIT 50",
)
def cases_in_order(spark, sf_dir):
    """Manual first, then by id, with the cap on cases as the feature."""
    df = base.read_table(spark, sf_dir, "labels", "doc_id", "quality")
    df = df.select("doc_id", "quality", F.when(F.col("quality") == 1, "manual").otherwise("auto").alias("provenance"), F.col("doc_id").cast("string").alias("id"))
    return cases.manual_first(df, max_cases=50).select("doc_id", "quality")


@query(
    "set_differences",
    """WITH a AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE value < 15) AS x, list(DISTINCT event_type) FILTER (WHERE value >= 15) AS y FROM events GROUP BY user_id)
        SELECT user_id, coalesce(array_to_string(list_sort(list_filter(x, lambda e: list_contains(coalesce(y, []), e))), ','), '') AS matched,
          coalesce(array_to_string(list_sort(list_filter(x, lambda e: NOT list_contains(coalesce(y, []), e))), ','), '') AS missing,
          coalesce(array_to_string(list_sort(list_filter(y, lambda e: NOT list_contains(coalesce(x, []), e))), ','), '') AS extra FROM a""",
)
def set_differences(spark, sf_dir):
    from gleaner.operators import media

    ev = base.read_table(spark, sf_dir, "events", "user_id", "event_type", "value")
    low, high = F.when(F.col("value") < 15, F.col("event_type")), F.when(F.col("value") >= 15, F.col("event_type"))
    df = ev.groupBy("user_id").agg(F.sort_array(F.collect_set(low)).alias("x"), F.sort_array(F.collect_set(high)).alias("y"))
    m = media.matched_points(F.col("x"), F.col("y"))
    return df.select("user_id", m.alias("m")).select("user_id", *[F.array_join(f"m.{n}", ",").alias(n) for n in ("matched", "missing", "extra")])


_LEDGER_SQL = """WITH p AS (SELECT user_id AS job_id, event_id AS seq, list_extract(['extract', 'summarize', 'write_note', 'notify'], CAST(event_id % 4 + 1 AS INT)) AS phase,
          CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS state, CASE WHEN event_type = 'error' OR value > 60 THEN event_type END AS warning FROM events),
        a AS (SELECT job_id, count(*) AS n_events, arg_max(state, seq) AS last_state, arg_max(phase, seq) AS last_phase FROM p GROUP BY job_id),
        w AS (SELECT job_id, string_agg(warning, ',' ORDER BY first_at, warning) AS warnings FROM (SELECT job_id, warning, min(seq) AS first_at FROM p WHERE warning IS NOT NULL GROUP BY ALL) GROUP BY job_id),
        h AS (SELECT job_id, phase, arg_max(state, seq) AS state FROM p GROUP BY ALL),
        n AS (SELECT unnest(['extract', 'summarize', 'write_note', 'notify']) AS phase, unnest(range(4)) AS i),
        s AS (SELECT a.job_id, string_agg(n.phase || ':' || coalesce(h.state, 'pending'), ',' ORDER BY i) AS phases FROM a, n LEFT JOIN h ON h.job_id = a.job_id AND h.phase = n.phase GROUP BY a.job_id)
        SELECT job_id, n_events, CASE WHEN last_state = 'failed' THEN 'failed' WHEN warnings IS NOT NULL THEN 'completed_with_warnings' ELSE 'done' END AS status,
          phases, coalesce(warnings, '') AS warnings, CASE WHEN last_state = 'failed' THEN last_phase END AS failed_phase
        FROM a JOIN s USING (job_id) LEFT JOIN w USING (job_id)"""


def _phase_events(ev):
    phases = F.array(*[F.lit(p) for p in ledger.PHASES])
    return ev.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.get(phases, (F.col("event_id") % 4).cast("int")).alias("phase"),
        F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"),
        F.when((F.col("event_type") == "error") | (F.col("value") > 60), F.col("event_type")).alias("warning"),
    )


def _ledger_rows(df):
    states = F.transform(F.array(*[F.lit(p) for p in ledger.PHASES]), lambda p: F.concat_ws(":", p, F.element_at("phases", p)))
    return df.select("job_id", "n_events", "status", F.array_join(states, ",").alias("phases"), F.array_join("warnings", ",").alias("warnings"), "failed_phase")


@query("job_ledger", _LEDGER_SQL)
def job_ledger(spark, sf_dir):
    """Status, phases and warnings per job from its phase events, by partial aggregation."""
    ev = base.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return _ledger_rows(ledger.final_ledger(_phase_events(ev)))


@query("job_ledger_stream", _LEDGER_SQL)
def job_ledger_stream(spark, sf_dir):
    """The same ledger from the parts of a stream over the event files."""
    run = run_folder(spark, "ledger")
    schema = base.read_table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    started = (
        ledger.stream_ledger(_phase_events(events), f"{run}/parts")
        .option("checkpointLocation", f"{run}/state")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return _ledger_rows(ledger.read_ledger(spark, f"{run}/parts"))
