"""Queries on the lines of a document: dedupe, budgets, groups, scored selection, signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.operators import compaction as cp
from gleaner.operators import lines as ln
from gleaner.operators import predicates as pr
from gleaner.operators import profiles, signals, steps
from gleaner.operators.keyed import keep_where
from gleaner.plans import base, sql
from gleaner.plans.registry import query

_LINES = sql.lines()


def _docs(spark, sf_dir):
    return base.documents(spark, sf_dir, "doc_id", "text")


def _rows(df, key, arr, value="line", ord_name="ord"):
    return ar.explode_rows(df, key, arr, value, ord_name)


@query(
    "first_wins_dedupe",
    f"""WITH {_LINES}, f AS (SELECT doc_id, lower({sql.squash("line")}) AS k, min(pos) AS pos FROM lines GROUP BY ALL)
        SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.pos) - 1 AS ord, l.line
        FROM lines l JOIN f ON l.doc_id = f.doc_id AND l.pos = f.pos""",
)
def first_wins_dedupe(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return _rows(df, "doc_id", ln.first_by_key(ar.lines(F.col("text")), tx.token))


@query(
    "first_wins_corpus",
    f"""WITH {_LINES} SELECT line, min(doc_id) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos, count(*) AS copies
        FROM lines GROUP BY line""",
)
def first_wins_corpus(spark, sf_dir):
    """First occurrence of every line in the corpus, by partial aggregation."""
    df = ln.explode_lines(_docs(spark, sf_dir), "doc_id", "text")
    at = F.min(F.struct("doc_id", "pos")).alias("at")
    return df.groupBy("line").agg(at, F.count("*").alias("copies")).select(
        "line", "at.doc_id", "at.pos", "copies"
    )


@query(
    "last_wins_dedupe",
    "SELECT url_key, arg_max(page_id, page_id) AS page_id FROM (SELECT split_part(split_part(url, '#', 1), '?', 1) AS url_key, page_id FROM pages) GROUP BY url_key",
)
def last_wins_dedupe(spark, sf_dir):
    from gleaner.operators.keyed import distinct_last

    df = base.read_table(spark, sf_dir, "pages", "page_id", "url")
    df = df.select(F.substring_index(F.substring_index("url", "#", 1), "?", 1).alias("url_key"), "page_id", F.col("page_id").alias("at"))
    return distinct_last(df, ["url_key"], ["at"]).drop("at")


_LABELS = ("Of", "The", "En la", "token =")


@query(
    "label_dedupe",
    f"""WITH {_LINES}, p AS (SELECT doc_id, pos, replace(line, '.', ':') AS line FROM lines),
        l AS (SELECT *, CASE WHEN contains(line, ':') THEN trim(split_part(line, ':', 1)) ELSE '' END AS label FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) AS rn FROM l)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, line FROM r
        WHERE rn = 1 OR NOT {sql.in_list("label", _LABELS)}""",
)
def label_dedupe(spark, sf_dir):
    df = _docs(spark, sf_dir)
    labelled = F.transform(ar.lines(F.col("text")), lambda x: F.replace(x, F.lit("."), F.lit(":")))
    return _rows(df, "doc_id", ln.dedupe_labels(labelled, _LABELS))


@query(
    "unique_line_ratio",
    f"""WITH {_LINES} SELECT d.doc_id, CAST(count(l.line) AS BIGINT) AS n_lines,
        CASE WHEN count(l.line) > 0 THEN round(count(DISTINCT l.line) / count(l.line), 6) ELSE 0 END AS unique_ratio
        FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def unique_line_ratio(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return df.select(
        "doc_id",
        F.size(ar.lines(F.col("text"))).cast("long").alias("n_lines"),
        F.round(ln.unique_ratio(F.col("text")), 6).alias("unique_ratio"),
    )


@query(
    "char_budget",
    f"""WITH {_LINES}, s AS (SELECT doc_id, line, row_number() OVER w - 1 AS ord,
          sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS used
          FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        SELECT doc_id, ord, line FROM s WHERE used <= 1200""",
)
def char_budget(spark, sf_dir):
    df = _docs(spark, sf_dir).withColumn("xs", ar.lines(F.col("text")))
    fit = ar.fits_prefix(F.transform("xs", lambda x: F.length(x)), 1200)
    return _rows(df, "doc_id", ar.take(F.col("xs"), fit))


@query(
    "block_groups",
    f"""WITH {_LINES}, m AS (SELECT *, sum(CAST(starts_with(line, 'The') OR starts_with(line, 'Der') AS INT))
          OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM lines)
        SELECT doc_id, g - 1 AS ord, arg_min(line, pos) AS head, count(*) - 1 AS n_items,
          coalesce(string_agg(line, ' | ' ORDER BY pos) FILTER (WHERE NOT (starts_with(line, 'The') OR starts_with(line, 'Der'))), '') AS items
        FROM m WHERE g > 0 GROUP BY doc_id, g""",
)
def block_groups(spark, sf_dir):
    df = _docs(spark, sf_dir)
    groups = ln.groups_by_marker(ar.lines(F.col("text")), lambda x: tx.starts_any(x, ("The", "Der")))
    df = _rows(df, "doc_id", groups, "g")
    return df.select(
        "doc_id", "ord", "g.head", F.size("g.items").alias("n_items"), F.array_join("g.items", " | ").alias("items")
    )


@query(
    "section_slices",
    f"""WITH {_LINES}, a AS (SELECT doc_id, min(pos) AS start FROM lines WHERE starts_with(line, 'The') GROUP BY doc_id),
        b AS (SELECT l.doc_id, min(l.pos) AS stop FROM lines l JOIN a ON a.doc_id = l.doc_id AND l.pos >= a.start
              WHERE contains(l.line, 'ing') GROUP BY l.doc_id)
        SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.pos) - 1 AS ord, l.line
        FROM lines l JOIN a ON a.doc_id = l.doc_id LEFT JOIN b ON b.doc_id = l.doc_id
        WHERE l.pos >= a.start AND (b.stop IS NULL OR l.pos < b.stop)""",
)
def section_slices(spark, sf_dir):
    """Lines captured between a start marker and a stop token."""
    df = _docs(spark, sf_dir)
    cut = ln.between_markers(
        ar.lines(F.col("text")), lambda x: F.startswith(x, F.lit("The")), lambda x: F.contains(x, F.lit("ing"))
    )
    return _rows(df, "doc_id", cut)


@query(
    "heading_slice",
    f"""WITH {_LINES}, p AS (SELECT doc_id, pos, CASE WHEN length(line) <= 40 THEN '## ' || substr(line, 1, 1) ELSE line END AS line FROM lines),
        a AS (SELECT doc_id, min(pos) AS start FROM p WHERE line = '## T' GROUP BY doc_id),
        b AS (SELECT p.doc_id, min(p.pos) AS stop FROM p JOIN a ON a.doc_id = p.doc_id AND p.pos > a.start
              WHERE starts_with(p.line, '## ') GROUP BY p.doc_id)
        SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) - 1 AS ord, p.line
        FROM p JOIN a ON a.doc_id = p.doc_id LEFT JOIN b ON b.doc_id = p.doc_id
        WHERE p.pos > a.start AND (b.stop IS NULL OR p.pos < b.stop)""",
)
def heading_slice(spark, sf_dir):
    df = _docs(spark, sf_dir)
    marked = F.transform(
        ar.lines(F.col("text")),
        lambda x: F.when(F.length(x) <= 40, F.concat(F.lit("## "), F.substring(x, 1, 1))).otherwise(x),
    )
    return _rows(df, "doc_id", ln.section_slice(marked, "## T"))


@query(
    "fence_filter",
    """WITH raw AS (SELECT doc_id, string_split(replace(text, 'The ', '```' || chr(10) || 'The '), chr(10)) AS xs FROM documents),
        n AS (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM raw),
        f AS (SELECT doc_id, i, xs[i] AS line, starts_with(trim(xs[i]), '```') AS fence FROM n),
        s AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM f)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s
        WHERE NOT fence AND c % 2 = 0 AND line <> '' GROUP BY doc_id""",
)
def fence_filter(spark, sf_dir):
    df = _docs(spark, sf_dir)
    fenced = F.split(F.replace("text", F.lit("The "), F.lit("```\nThe ")), "\n")
    df = keep_where(df.select("doc_id", ln.outside_fences(fenced).alias("xs")), F.size("xs") > 0)
    chars = F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return df.select("doc_id", F.size("xs").cast("long").alias("n_lines"), chars.alias("n_chars"))


_MEDIA = lx.MediaScoreLexicon(
    topical=("licens", "token", "@mail", "the and", "der die"), links=("@mail", "555-"), commands=("version", "token"),
    chatter=("stupid", "scum", "trash"),
)
_QUIET_PREFIX = ("Of.", "La ", "Ietzte")


def _noise(c):
    return pr.is_ui_noise(c, exact=("And ornd.",), filing=("disgusting",), footer=("zzz",), author_suffix="zzz") | tx.starts_any(c, _QUIET_PREFIX)


_SCORE_SQL = f"""(CASE WHEN {sql.contains_any("low", _MEDIA.topical)} THEN 4 ELSE 0 END
      + CASE WHEN {sql.contains_any("low", _MEDIA.links)} THEN 4 ELSE 0 END
      + CASE WHEN {sql.contains_any("low", _MEDIA.commands)} THEN 3 ELSE 0 END
      + CASE WHEN length(line) >= 14 THEN 1 ELSE 0 END - CASE WHEN length(line) > 220 THEN 2 ELSE 0 END
      - CASE WHEN {sql.contains_any("line", _MEDIA.chatter)} THEN 5 ELSE 0 END
      - CASE WHEN regexp_matches(line, '^[0-9: /.-]+$') THEN 4 ELSE 0 END)"""
_NOISE_SQL = rf"""(line = 'And ornd.' OR starts_with(line, '#') OR regexp_matches(line, '^\d+(/\d+)?$')
      OR contains(line, 'disgusting') OR {sql.starts_any("line", _QUIET_PREFIX)})"""
_NORM = sql.strip(r"regexp_replace(line, '[ \t]+', ' ', 'g')")

_ENTRIES_SQL = f"""norm AS (SELECT doc_id, pos, {_NORM} AS line FROM lines),
      uniq AS (SELECT doc_id, pos, line, lower({sql.squash("line")}) AS k,
                 row_number() OVER (PARTITION BY doc_id, lower({sql.squash("line")}) ORDER BY pos) AS rn FROM norm),
      scored AS (SELECT doc_id, pos, line, {_SCORE_SQL} AS score, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
                 FROM (SELECT *, lower(line) AS low FROM uniq WHERE rn = 1) WHERE NOT {_NOISE_SQL}
                 AND NOT regexp_matches(line, '^\\d{{1,2}}:\\d{{2}}$'))"""


def _compact_sql(seed: int, max_lines: int, pad: int, budget: int, clip: int, table: str = "documents", before: str = "") -> str:
    # Text of which every line is noise is kept as it is, cut to the budget.
    whole = sql.strip(rf"regexp_replace(regexp_replace(r.whole, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")
    whole = sql.rstrip(f"substr({whole}, 1, {budget})")
    return f"""WITH {before}{sql.lines(table)}, {_ENTRIES_SQL},
      strong AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n > {seed}, score >= 2 ORDER BY score DESC, pos) AS sr,
                   row_number() OVER (PARTITION BY doc_id, n > {seed}, score >= 2 ORDER BY pos) AS wr FROM scored),
      sizes AS (SELECT doc_id, least({max_lines}, count(*) FILTER (WHERE n <= {seed})
                 + least({max_lines} - {seed}, count(*) FILTER (WHERE n > {seed} AND score >= 2))) AS have FROM strong GROUP BY doc_id),
      chosen AS (SELECT s.* FROM strong s JOIN sizes z USING (doc_id)
               WHERE n <= {seed} OR (score >= 2 AND sr <= {max_lines - seed}) OR (score < 2 AND wr <= greatest(0, {min(pad, max_lines)} - have))),
      cut_lines AS (SELECT doc_id, {sql.clip("line", clip)} AS piece,
                 row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN score >= 10 THEN 0 WHEN score >= 6 THEN 1 ELSE 2 END,
                                    CASE WHEN score >= 10 THEN -score ELSE 0 END, pos) AS o FROM chosen),
      used AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) - 1 AS u FROM cut_lines),
      fit AS (SELECT doc_id, string_agg(piece, chr(10) ORDER BY o) AS text, count(*) AS kept_lines FROM used WHERE u <= {budget} GROUP BY doc_id),
      raw_stats AS (SELECT d.doc_id, {sql.strip("d.text")} AS whole, (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id) AS raw_lines FROM {table} d),
      shown AS (SELECT r.*, CASE WHEN r.doc_id IN (SELECT doc_id FROM scored) THEN coalesce(f.text, '') ELSE {whole} END AS out,
                CASE WHEN r.doc_id IN (SELECT doc_id FROM scored) THEN coalesce(f.kept_lines, 0) WHEN {whole} = '' THEN 0
                     ELSE len(string_split({whole}, chr(10))) END AS n FROM raw_stats r LEFT JOIN fit f USING (doc_id))
      SELECT doc_id, out AS text, raw_lines, n AS kept_lines, length(whole) AS raw_chars, length(out) AS kept_chars FROM shown"""


@query("compact_evidence", _compact_sql(6, 24, 12, 1200, 240))
def compact_evidence(spark, sf_dir):
    df = cp.compact_evidence(
        _docs(spark, sf_dir), max_lines=24, max_chars=1200, lexicon=_MEDIA, noise=_noise, seed_lines=6, pad_lines=12
    )
    return df.select("doc_id", "compact.*")


@query(
    "compaction_totals",
    f"""WITH c AS ({_compact_sql(36, 220, 80, 12000, 240)})
        SELECT count(*) AS docs, CAST(sum(raw_lines) AS BIGINT) AS raw_lines, CAST(sum(kept_lines) AS BIGINT) AS kept_lines,
          CAST(sum(raw_chars) AS BIGINT) AS raw_chars, CAST(sum(kept_chars) AS BIGINT) AS kept_chars FROM c""",
)
def compaction_totals(spark, sf_dir):
    df = cp.compact_evidence(_docs(spark, sf_dir), lexicon=_MEDIA, noise=_noise)
    names = ("raw_lines", "kept_lines", "raw_chars", "kept_chars")
    return df.agg(
        F.count("*").alias("docs"), *[F.sum(F.col("compact")[n].cast("long")).alias(n) for n in names]
    )


_SAL = lx.SalientLexicon(
    link_contains=("@mail",), link_starts=("Released", "Licensed"), skill=("token", "version"), labels=("The", "Der"),
    product=("555-",), noise=("stupid", "trash"),
)


@query(
    "salient_lines",
    f"""WITH {_LINES}, s AS (SELECT *, lower(line) AS low FROM lines),
        r AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY
            (CASE WHEN contains(low, '@mail') OR starts_with(low, 'Released') OR starts_with(low, 'Licensed') THEN 8 ELSE 0 END
             + CASE WHEN {sql.contains_any("low", _SAL.skill)} THEN 6 ELSE 0 END
             + CASE WHEN {sql.starts_any("line", _SAL.labels)} THEN 6 ELSE 0 END
             + CASE WHEN regexp_matches(line, '\\b[a-z][a-z0-9]+(?:-[a-z0-9]+){{1,5}}\\b') THEN 4 ELSE 0 END
             + CASE WHEN contains(low, '555-') THEN 3 ELSE 0 END
             - CASE WHEN {sql.contains_any("low", _SAL.noise)} THEN 4 ELSE 0 END) DESC, pos) AS rn FROM s),
        f AS (SELECT doc_id, line, min(pos) AS pos FROM r WHERE rn <= 20 GROUP BY doc_id, line),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f)
        SELECT doc_id, n - 1 AS ord, CASE WHEN length(line) > 180 THEN {sql.rstrip("substr(line, 1, 180)")} ELSE line END AS line FROM o WHERE n <= 8""",
)
def salient_lines(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return _rows(df, "doc_id", cp.salient_lines(ar.lines(F.col("text")), 8, _SAL))


_KEY_WEIGHTS = ((("license", "licensed"), 10), (("token",), 9), (("@mail", "555-"), 8), (("trash", "scum", "stupid"), -4), (("the ",), 2))


def _key_score(c):
    return cp.doc_key_score(c, _KEY_WEIGHTS)


def _md(c: str) -> str:
    return f"{sql.squash('trim(' + c + ', ' + sql.lit(' -*' + chr(9)) + ')')}"


_FOCUS = ("apache", "gnu")


@query(
    "doc_key_lines",
    f"""WITH {_LINES}, md AS (SELECT doc_id, pos, {_md(r"regexp_replace(regexp_replace(line, '^#{1,6}\s*', ''), '^\d+\.\s+', '')")} AS line FROM lines),
        s AS (SELECT *, lower(line) AS low FROM md WHERE line <> ''),
        c AS (SELECT *, (CASE WHEN {sql.contains_any("low", ("license", "licensed"))} THEN 10 ELSE 0 END
              + CASE WHEN contains(low, 'token') THEN 9 ELSE 0 END + CASE WHEN {sql.contains_any("low", ("@mail", "555-"))} THEN 8 ELSE 0 END
              - CASE WHEN {sql.contains_any("low", ("trash", "scum", "stupid"))} THEN 4 ELSE 0 END + CASE WHEN contains(low, 'the ') THEN 2 ELSE 0 END
              + CASE WHEN {sql.contains_any("low", ("cri ", "cri-"))} OR starts_with(low, 'cri') THEN 5 ELSE 0 END
              + CASE WHEN regexp_matches(low, '\\b[a-z][a-z0-9]+(?:-[a-z0-9]+){{1,5}}\\b') THEN 3 ELSE 0 END) AS score FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM c
              WHERE score > 0 AND length(line) >= 8 AND NOT (starts_with(line, '[') AND ends_with(line, ']'))
              AND NOT {sql.contains_any("low", lx.DOC_KEY_NOISE)}),
        p0 AS (SELECT doc_id, {sql.clip("line", 160)} AS line, min(pos) AS pos FROM r WHERE rn <= 20 GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM p0),
        q AS (SELECT doc_id, line, n FROM p WHERE n <= 14),
        x AS (SELECT s.doc_id, {sql.clip("s.line", 160)} AS line, 1000 + min(s.pos) AS n FROM s
              WHERE {sql.contains_any("s.low", _FOCUS)} AND s.doc_id IN (SELECT doc_id FROM q)
                AND NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = s.doc_id AND q.line = s.line) GROUP BY 1, 2),
        u AS (SELECT doc_id, line, min(n) AS n FROM (SELECT * FROM q UNION ALL SELECT * FROM x) GROUP BY 1, 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM u)
        SELECT doc_id, k - 1 AS ord, line FROM o WHERE k <= 18""",
)
def doc_key_lines(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return _rows(df, "doc_id", cp.doc_key_lines(F.col("text"), _key_score, focus=_FOCUS))


@query(
    "timeline_highlights",
    f"""WITH {_LINES}, t AS (SELECT doc_id, pos, '[' || CASE WHEN pos >= 3600 THEN printf('%02d:%02d:%02d', pos // 3600, pos % 3600 // 60, pos % 60) ELSE printf('%02d:%02d', pos // 60, pos % 60) END || '] ' || {_NORM} AS line FROM lines),
        s AS (SELECT *, lower(line) AS low FROM t WHERE NOT {_NOISE_SQL}),
        r AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY
              ({_SCORE_SQL} - CASE WHEN contains(line, 'in ') THEN 5 ELSE 0 END - CASE WHEN length(line) < 16 THEN 2 ELSE 0 END) DESC, pos) AS rn FROM s)
        SELECT doc_id, rn - 1 AS ord, line FROM r WHERE rn <= 8""",
)
def timeline_highlights(spark, sf_dir):
    from gleaner.functions.times import clock_label

    raw = F.split("text", "\n")
    labelled = F.transform(
        raw,
        lambda x, i: F.when(tx.strip(x) != "", F.concat(F.lit("["), clock_label(i), F.lit("] "), x)),
    )
    df = _docs(spark, sf_dir)
    kept = F.filter(labelled, lambda x: x.isNotNull())
    found = cp.timeline_highlights(kept, lexicon=_MEDIA, noise=_noise, chatter=("in ",))
    return _rows(df, "doc_id", found)


@query(
    "enumerated_points",
    r"""WITH w AS (SELECT doc_id, string_split(text, '. ') AS xs FROM documents),
        n AS (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM w),
        l AS (SELECT doc_id, i, (i - 1) % 7 + CASE WHEN doc_id % 3 = 0 AND i > 3 THEN 2 ELSE 1 END AS num, trim(regexp_replace(xs[i], '\s+', ' ', 'g')) AS content FROM n),
        f AS (SELECT doc_id, num, arg_min(content, i) AS content FROM l WHERE num BETWEEN 1 AND 12 AND length(content) >= 2 GROUP BY doc_id, num),
        g AS (SELECT doc_id FROM f GROUP BY doc_id HAVING count(*) >= 3 AND max(num) - min(num) + 1 = count(*))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY num) - 1 AS ord, content AS point FROM f WHERE doc_id IN (SELECT doc_id FROM g)""",
)
def enumerated_points(spark, sf_dir):
    """Sentences numbered 1..7 over and over; some documents skip a number."""
    df = _docs(spark, sf_dir)
    numbered = F.transform(
        F.split("text", r"\. "),
        lambda x, i: F.concat(
            (i % 7 + F.when((F.col("doc_id") % 3 == 0) & (i >= 3), F.lit(2)).otherwise(F.lit(1))).cast("string"),
            F.lit(". "),
            F.regexp_replace(x, r"\s+", " "),
        ),
    )
    points = steps.enumerated_points(F.array_join(numbered, "\n"))
    return _rows(df, "doc_id", points, "point")


@query(
    "first_k_per_document",
    f"""WITH {_LINES}, k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE length(line) BETWEEN 8 AND 120)
        SELECT doc_id, string_agg(line, ' | ' ORDER BY n) AS bullets FROM k WHERE n <= 5 GROUP BY doc_id""",
)
def first_k_per_document(spark, sf_dir):
    df = _docs(spark, sf_dir)
    kept = F.filter(ar.lines(F.col("text")), lambda x: F.length(x).between(8, 120))
    df = keep_where(df.select("doc_id", ar.take(kept, 5).alias("k")), F.size("k") > 0)
    return df.select("doc_id", F.array_join("k", " | ").alias("bullets"))


# --- signals --------------------------------------------------------------------

_SIG = signals.SignalLexicon(
    high_value_domains=("example.org", "blog."),
    low_value_domains=("spam-farm.",),
    forced_source=("/en/",),
    keyword_lines={
        "prerequisites": ("licens",), "validation_actions": ("token", "555-"), "use_cases": ("version", "the and"),
        "purposes": ("with the",), "boundaries": ("stupid", "trash"), "common_errors": ("403", "@mail"),
    },
    prerequisite_starts=("Released",),
)


def signal_table(spark, sf_dir):
    df = base.requests(spark, sf_dir)
    return signals.extract_signals(df, lexicon=_SIG)


_CANON_TEXT_URL = """lower(regexp_extract(u, '^[^:]+://[^/?#]*')) || CASE WHEN regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1) END || CASE WHEN q = '' THEN '' ELSE '?' || q END"""


@query(
    "link_signals",
    rf"""WITH {sql.REQUESTS},
        f AS (SELECT doc_id, rtrim(regexp_extract(text, 'https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+'), ')]}}>,.;，。；：') AS u FROM requests),
        k AS (SELECT doc_id, u, CASE WHEN contains(u, 'utm_source') THEN '' ELSE regexp_extract(u, '\?([^#]*)', 1) END AS q FROM f WHERE u <> ''),
        c AS (SELECT doc_id, {_CANON_TEXT_URL} AS value FROM k)
        SELECT doc_id, 0 AS ord, value FROM c WHERE contains(value, '/en/') OR
          ((contains(value, 'example.org') OR contains(value, 'blog.')) AND NOT contains(value, 'spam-farm.'))""",
)
def link_signals(spark, sf_dir):
    df = signal_table(spark, sf_dir)
    return _rows(df, "doc_id", F.col("signals.links"), "value")


@query(
    "hashtag_signals",
    rf"""WITH {sql.REQUESTS}, f AS (SELECT doc_id, regexp_extract_all(text, '#([A-Za-z0-9_\-\x{{4e00}}-\x{{9fff}}]{{2,30}})', 1) AS ts FROM requests),
        u AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM f),
        g AS (SELECT doc_id, '#' || t AS value, min(i) AS i FROM u GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g)
        SELECT doc_id, n - 1 AS ord, value FROM o WHERE n <= 10""",
)
def hashtag_signals(spark, sf_dir):
    df = signal_table(spark, sf_dir)
    return _rows(df, "doc_id", F.col("signals.hashtags"), "value")


def _keyword_sql() -> str:
    parts = []
    for kind, tokens in _SIG.keyword_lines.items():
        key = "replace(low, ' ', '')" if kind in ("boundaries", "common_errors") else "low"
        test = sql.contains_any(key, tokens)
        if kind == "prerequisites":
            test = f"({test} OR starts_with(line, 'Released'))"
        parts.append(f"SELECT doc_id, pos, line, '{kind}' AS kind FROM k WHERE {test}")
    return " UNION ALL ".join(parts)


_KEYWORD_ROWS = f"""k AS (SELECT *, lower(line) AS low FROM lines WHERE length(line) BETWEEN 6 AND 220),
      h AS ({_keyword_sql()}), f AS (SELECT doc_id, kind, line, min(pos) AS pos FROM h GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS n FROM f)"""


@query(
    "signal_counts",
    rf"""WITH {sql.REQUESTS}, {sql.lines("requests")}, {_KEYWORD_ROWS},
        u AS (SELECT doc_id, rtrim(regexp_extract(text, 'https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+'), ')]}}>,.;，。；：') AS u FROM requests),
        t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '#([A-Za-z0-9_\-\x{{4e00}}-\x{{9fff}}]{{2,30}})', 1)) AS ts FROM requests)
        SELECT kind, count(*) AS n_values FROM o WHERE n <= 6 GROUP BY kind
        UNION ALL SELECT 'links', count(*) FROM u WHERE contains(u, '/en/') OR ((contains(u, 'example.org') OR contains(u, 'blog.')) AND NOT contains(u, 'spam-farm.'))
        UNION ALL SELECT 'hashtags', CAST(sum(least(len(ts), 10)) AS BIGINT) FROM t""",
)
def signal_counts(spark, sf_dir):
    """Rows per signal kind; kinds that the data never shows must stay absent."""
    return signals.long_form(signal_table(spark, sf_dir), "doc_id").groupBy("kind").agg(F.count("*").alias("n_values"))


@query(
    "keyword_line_signals",
    f"""WITH {sql.REQUESTS}, {sql.lines("requests")}, k AS (SELECT *, lower(line) AS low FROM lines WHERE length(line) BETWEEN 6 AND 220),
        h AS ({_keyword_sql()}), f AS (SELECT doc_id, kind, line, min(pos) AS pos FROM h GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS n FROM f)
        SELECT doc_id, kind, n - 1 AS ord, line AS value FROM o WHERE n <= 6""",
)
def keyword_line_signals(spark, sf_dir):
    df = signals.long_form(signal_table(spark, sf_dir), "doc_id")
    return df.filter(F.col("kind").isin(*_SIG.keyword_lines))




_PROF = lx.ProfileLexicon(skill=("licens",), install=("token", "555-"), project=("@mail", "trash"), project_hosts=("/de/",))

_PROFILE_SQL = f"""CASE WHEN source_kind = 'video_url' THEN 'video_explainer'
      WHEN {sql.contains_any("lower(text)", _PROF.skill)} THEN 'skill_recommendation'
      WHEN {sql.contains_any("lower(text)", _PROF.install)} THEN 'installation_tutorial'
      WHEN contains(lower(coalesce(source_url, '')), '/de/') OR {sql.contains_any("lower(text)", _PROF.project)} THEN 'project_overview'
      ELSE 'general_capture' END"""


def profiled(spark, sf_dir):
    df = signal_table(spark, sf_dir)
    kind = profiles.infer_profile(
        F.col("source_kind"), F.col("source_url"), F.col("text"), F.col("signals"), F.lit(False), _PROF
    )
    return df.withColumn("profile", kind)


@query(
    "content_profile",
    f"""WITH {sql.REQUESTS} SELECT doc_id, {_PROFILE_SQL} AS profile FROM requests""",
)
def content_profile(spark, sf_dir):
    return profiled(spark, sf_dir).select("doc_id", "profile")


@query(
    "profile_requirements",
    rf"""WITH {sql.REQUESTS}, p AS (SELECT doc_id, source_url, text, {_PROFILE_SQL} AS profile FROM requests),
        f AS (SELECT doc_id, profile, rtrim(regexp_extract(text, 'https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+'), ')]}}>,.;，。；：') AS u FROM p),
        k AS (SELECT doc_id, profile, u, CASE WHEN contains(u, 'utm_source') THEN '' ELSE regexp_extract(u, '\?([^#]*)', 1) END AS q FROM f WHERE u <> ''),
        c AS (SELECT doc_id, profile, {_CANON_TEXT_URL} AS value FROM k)
        SELECT doc_id, 'links' AS key, value FROM c WHERE profile IN ('skill_recommendation', 'project_overview', 'video_explainer')
          AND (contains(value, '/en/') OR ((contains(value, 'example.org') OR contains(value, 'blog.')) AND NOT contains(value, 'spam-farm.')))""",
)
def profile_requirements(spark, sf_dir):
    df = profiled(spark, sf_dir)
    values = profiles.required_values(F.col("profile"), F.col("signals"))
    return ar.explode_rows(df, "doc_id", values, "r").select("doc_id", "r.key", "r.value")


@query(
    "evidence_gate",
    f"""WITH {sql.REQUESTS}, v AS (SELECT doc_id, source_kind, {sql.strip("text")} AS v FROM requests)
        SELECT doc_id, CASE WHEN v = '' THEN false WHEN source_kind = 'pasted_text' THEN true
          WHEN source_kind IN ('image', 'video_url', 'mixed') AND length(v) >= 60 THEN true ELSE length(v) >= 80 END AS passes FROM v""",
)
def evidence_gate(spark, sf_dir):
    df = base.requests(spark, sf_dir)
    gate = pr.evidence_gate(F.col("source_kind"), F.col("text"), F.col("source_url"), F.lit(False), ar.empty_strings())
    return df.select("doc_id", gate.alias("passes"))


@query(
    "needs_ocr",
    f"""WITH {sql.REQUESTS} SELECT doc_id, CASE WHEN source_url IS NULL THEN false ELSE length({sql.strip("text")}) <
          CASE WHEN source_kind = 'mixed' THEN 900 ELSE 280 END END AS needs_ocr FROM requests""",
)
def needs_ocr(spark, sf_dir):
    df = base.requests(spark, sf_dir)
    return df.select("doc_id", pr.needs_ocr(F.col("source_kind"), F.col("source_url"), F.col("text")).alias("needs_ocr"))


@query(
    "ocr_lines",
    rf"""WITH {_LINES}, t AS (SELECT doc_id, pos, trim(regexp_replace({_NORM}, '^[^\p{{L}}\p{{N}}_#@:/.-]+', '')) AS line FROM lines),
        k AS (SELECT * FROM t WHERE line <> '' AND NOT starts_with(line, '#') AND NOT regexp_matches(line, '^\d+(/\d+)?$')
          AND NOT (regexp_matches(line, '[?？]$') AND length(line) <= 36)
          AND (contains(lower(line), 'token') OR contains(lower(line), '@mail')
               OR regexp_matches(line, '\b[a-z][a-z0-9]+(?:-[a-z0-9]+){{1,5}}\b')
               OR contains(lower(line), 'http://') OR contains(lower(line), 'https://'))
          AND NOT {sql.contains_any("lower(line)", lx.OCR_LOW_VALUE)}),
        g AS (SELECT doc_id, CASE WHEN length(line) > 220 THEN {sql.rstrip("substr(line, 1, 220)")} ELSE line END AS line, min(pos) AS pos FROM k GROUP BY 1, 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM g)
        SELECT doc_id, n - 1 AS ord, line FROM o WHERE n <= 25""",
)
def ocr_lines(spark, sf_dir):
    df = _docs(spark, sf_dir)
    return _rows(df, "doc_id", pr.filter_ocr_lines(F.col("text"), strict=False, signal_tokens=("token", "@mail")))


@query(
    "corpus_line_frequency",
    f"""WITH {_LINES} SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY line HAVING count(*) >= 5""",
)
def corpus_line_frequency(spark, sf_dir):
    """Repeated lines. Per-document counts first, so a hot line arrives pre-summed."""
    df = ln.explode_lines(_docs(spark, sf_dir), "doc_id", "text")
    per_doc = df.groupBy("line", "doc_id").agg(F.count("*").alias("c"))
    total = per_doc.groupBy("line").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))
    return total.filter("n >= 5")


@query(
    "order_preserved",
    f"""WITH x AS (SELECT b.item_id, {sql.strip("b.text")} AS t, string_split(b.text, '. ') AS ps FROM benchmark b),
        p AS (SELECT item_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM x),
        q AS (SELECT item_id, i, trim(ps[i]) AS point, row_number() OVER (PARTITION BY item_id ORDER BY length(trim(ps[i])), i) AS j FROM p WHERE trim(ps[i]) <> ''),
        g AS (SELECT *, lag(j) OVER (PARTITION BY item_id ORDER BY i) AS before FROM q)
        SELECT item_id, bool_and(before IS NULL OR before < j) AS order_preserved FROM g GROUP BY item_id""",
)
def order_preserved(spark, sf_dir):
    """Do the points of an item, ordered by length, keep their original order?"""
    df = base.read_table(spark, sf_dir, "benchmark")
    points = F.filter(F.transform(F.split("text", r"\. "), lambda x: F.trim(x)), lambda x: x != "")
    df = ar.explode_rows(df, "item_id", points, "point", "i")
    w = Window.partitionBy("item_id")
    df = df.withColumn("j", F.row_number().over(w.orderBy(F.length("point"), "i")))
    df = df.withColumn("before", F.lag("j").over(w.orderBy("i")))
    ok = F.col("before").isNull() | (F.col("before") < F.col("j"))
    return df.groupBy("item_id").agg(F.bool_and(ok).alias("order_preserved"))
