"""Transcript payloads, caption files and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import times as tm
from gleaner.operators.keyed import distinct_first, top_per_key
from gleaner.operators.lines import first_by_key

#: Fields a transcript payload may have. Values arrive as text, whatever they were.
PAYLOAD = (
    "text STRING, transcript STRING, subtitle STRING, content STRING, language STRING, duration_seconds STRING, "
    "duration STRING, duration_sec STRING, duration_ms STRING, "
    "segments ARRAY<STRUCT<text: STRING, start: STRING, start_seconds: STRING, offset: STRING, end: STRING>>"
)
CUE = r"^(\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3})\s*-->\s*(\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3})"


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(tx.strip(c), F.lit("")) for c in columns])


def parse_transcripts(df: DataFrame, payload: str, out: str = "transcript", timeline_limit: int | None = None) -> DataFrame:
    """Add struct(text, language, duration_seconds, timeline) from JSON or plain text.

    Valid JSON without usable text gives empty text, never the JSON itself. Text and
    duration cover all segments; ``timeline_limit`` only shortens the timeline shown.
    """
    raw = tx.strip(tx.text_or_empty(F.col(payload)))
    parsed = F.from_json(F.when(F.startswith(raw, F.lit("{")), raw), PAYLOAD)
    df = df.withColumns({"_raw": raw, "_p": parsed})
    is_json = F.startswith(F.col("_raw"), F.lit("{")) & F.try_parse_json("_raw").isNotNull()
    p = F.col("_p")

    def line(s: Column) -> Column:
        start = F.coalesce(*[tm.parse_duration(s[n]) for n in ("start", "start_seconds", "offset")])
        body = tx.strip(s["text"])
        return F.when(start.isNull(), body).otherwise(F.concat(F.lit("["), tm.clock_label(start), F.lit("] "), body))

    spoken = F.filter(p["segments"], lambda s: tx.strip(tx.text_or_empty(s["text"])) != "")
    df = df.withColumn("_seg", F.coalesce(F.transform(spoken, line), ar.empty_strings()))
    given = _filled(p["text"], p["transcript"], p["subtitle"], p["content"])
    text = F.when(is_json, F.coalesce(given, F.array_join("_seg", "\n"))).otherwise(F.col("_raw"))
    df = df.withColumn("_text", text)
    duration = F.coalesce(
        *[tm.parse_duration(p[n]) for n in ("duration_seconds", "duration", "duration_sec", "duration_ms")],
        tm.max_clock(F.col("_text")),
    )
    result = F.struct(
        F.col("_text").alias("text"),
        p["language"].alias("language"),
        duration.alias("duration_seconds"),
        ar.take(F.col("_seg"), timeline_limit).alias("timeline"),
    )
    return df.withColumn(out, result).drop("_raw", "_p", "_seg", "_text")


def normalize_transcription(df: DataFrame, payload: str, out: str = "asr") -> DataFrame:
    """Speech-recognition form: joined text, lower-case language, duration, kept segments."""
    df = df.withColumn("_p", F.from_json(F.col(payload), PAYLOAD))
    p = F.col("_p")

    def segment(s: Column) -> Column:
        start = F.coalesce(s["start"].try_cast("double"), F.lit(0.0))
        return F.struct(
            F.round(start, 3).alias("start"),
            F.round(F.coalesce(s["end"].try_cast("double"), start), 3).alias("end"),
            tx.strip(s["text"]).alias("text"),
        )

    spoken = F.filter(p["segments"], lambda s: tx.strip(tx.text_or_empty(s["text"])) != "")
    df = df.withColumn("_s", F.coalesce(F.transform(spoken, segment), F.expr("array()").cast("array<struct<start:double,end:double,text:string>>")))
    given = F.nullif(tx.strip(tx.text_or_empty(p["text"])), F.lit(""))
    joined = F.array_join(F.transform("_s", lambda s: s["text"]), " ")
    ends = F.array_max(F.transform("_s", lambda s: s["end"]))
    duration = F.coalesce(
        *[F.round(p[n].try_cast("double"), 3) for n in ("duration_seconds", "duration", "duration_sec")],
        F.round(p["duration_ms"].try_cast("double") / 1000, 3),
        F.round(ends, 3),
    )
    result = F.struct(
        tx.squash(F.coalesce(given, joined)).alias("text"),
        F.lower(tx.strip(tx.text_or_empty(p["language"]))).alias("language"),
        duration.alias("duration_seconds"),
        F.col("_s").alias("segments"),
    )
    return df.withColumn(out, result).drop("_p", "_s")


def clean_caption(c: Column) -> Column:
    return tx.squash(F.regexp_replace(tx.unescape(tx.strip(c)), "<[^>]+>", " "))


def vtt_segments(content: Column, max_seconds: float = 0.0, limit: int | None = None) -> Column:
    """array<struct<start,end,text>> of a caption file, each text once.

    A cue runs from its time line to the next time line or blank line.
    """
    mark = "\x01"
    raw = F.split(tx.text_or_empty(content), tx.LINE_BREAK)
    # A marker before every time line and every blank line; cues are the pieces
    # that begin with a time line.
    marked = F.transform(
        raw, lambda x: F.when(x.rlike(CUE) | (tx.strip(x) == ""), F.concat(F.lit(mark), x)).otherwise(x)
    )
    pieces = F.filter(F.split(F.array_join(marked, "\n"), mark), lambda p: p.rlike(CUE))

    def cue(p: Column) -> Column:
        body = F.filter(
            F.transform(F.split(p, "\n"), lambda x: tx.strip(x)),
            lambda x: ~x.rlike(CUE) & ~x.rlike(r"^\d+$") & ~tx.starts_any(x, ("WEBVTT", "NOTE", "Kind:", "Language:")),
        )
        start, end = tm.clock_seconds(F.regexp_extract(p, CUE, 1)), tm.clock_seconds(F.regexp_extract(p, CUE, 2))
        words = F.filter(F.transform(body, clean_caption), lambda x: x != "")
        return F.struct(
            F.round(start, 3).alias("start"), F.round(end, 3).alias("end"), F.array_join(words, " ").alias("text")
        )

    cues = F.filter(F.transform(pieces, cue), lambda s: s["text"] != "")
    if max_seconds > 0:
        cues = F.filter(cues, lambda s: s["start"] < max_seconds)
    return ar.take(first_by_key(cues, lambda s: s["text"]), limit)


def normalize_segments(segments: Column, max_seconds: float = 0.0, limit: int | None = None) -> Column:
    """Cleaned segments inside the horizon, each text once."""
    cleaned = F.transform(
        segments,
        lambda s: F.struct(
            F.round(s["start"], 3).alias("start"), F.round(s["end"], 3).alias("end"), clean_caption(s["text"]).alias("text")
        ),
    )
    kept = F.filter(cleaned, lambda s: s["text"] != "")
    if max_seconds > 0:
        kept = F.filter(kept, lambda s: s["start"] < max_seconds)
    return ar.take(first_by_key(kept, lambda s: s["text"]), limit)


def normalize_segment_rows(rows: DataFrame, key: str, max_seconds: float = 0.0, limit: int | None = None) -> DataFrame:
    """The same rule on a long table (key, ord, start, end, text).

    For segments that do not sit in one row: the first of equal texts is a partial
    aggregation and the limit a ranked filter, so a very long transcript never has
    to meet in one task.
    """
    df = rows.withColumn("text", clean_caption(F.col("text"))).filter("text <> ''")
    if max_seconds > 0:
        df = df.filter(F.col("start") < max_seconds)
    df = df.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})
    first = distinct_first(df.withColumn("_o", F.col("ord")), [key, "text"], ["_o"]).drop("_o")
    return first if limit is None else top_per_key(first, [key], [F.col("ord").asc()], limit).drop("rank")


def timeline(segments: Column, limit: int | None = None) -> Column:
    lines = F.transform(segments, lambda s: F.concat(F.lit("["), tm.clock_label(s["start"]), F.lit("] "), s["text"]))
    return ar.take(lines, limit)


def best_caption(tracks: DataFrame, key: str, name: str, languages: tuple[str, ...]) -> DataFrame:
    """One caption file per key: no live chat, best language, no automatic track."""
    low = F.lower(F.col(name))
    lang = F.regexp_extract(low, r"\.([a-z]{2}(?:-[a-z0-9]+)?)", 1)
    rank = F.lit(len(languages) + 5)
    for i in reversed(range(len(languages))):
        rank = F.when(F.startswith(lang, F.lit(languages[i])), F.lit(i)).otherwise(rank)
    order = F.struct(
        F.contains(low, F.lit("live_chat")).cast("int"),
        rank,
        tx.contains_any(low, (".orig.", ".auto.")).cast("int"),
        F.col(name),
    )
    others = [c for c in tracks.columns if c != key]
    return tracks.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_t")).select(key, "_t.*")
