"""URL expressions built from substring functions, without a URL parser per row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx


def _after(c: Column, sep: str) -> Column:
    """Part behind the first ``sep``; empty when there is none."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.substring(c, at + len(sep), F.length(c))).otherwise(F.lit(""))


def parts(c: Column) -> Column:
    """struct(scheme, netloc, path, query) of a trimmed URL."""

    def split(base: Column, rest: Column, query: Column) -> Column:
        netloc = F.substring_index(rest, "/", 1)
        return F.struct(
            F.when(F.contains(base, F.lit("://")), F.substring_index(base, "://", 1)).otherwise(F.lit("")).alias("scheme"),
            netloc.alias("netloc"),
            F.substring(rest, F.length(netloc) + 1, F.length(rest)).alias("path"),
            query.alias("query"),
        )

    return tx.let(
        F.substring_index(c, "#", 1),
        lambda u: tx.let(
            F.substring_index(u, "?", 1),
            lambda base: tx.let(_after(base, "://"), lambda rest: split(base, rest, _after(u, "?"))),
        ),
    )


def with_parts(c: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(trimmed url, parts)`` with both bound once."""
    return tx.let(tx.strip(c), lambda v: tx.let(parts(v), lambda p: body(v, p)))


def host(c: Column) -> Column:
    return F.lower(with_parts(c, lambda _, p: p["netloc"]))


def path(c: Column) -> Column:
    return with_parts(c, lambda _, p: p["path"])


def _recode(c: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(c), c)
    return F.when(c.rlike(r"^[A-Za-z0-9_.~-]*$"), c).otherwise(tx.percent_encode(decoded, space="+"))


def clean_query(query: Column, ignored: Iterable[str] = lx.TRACKING_KEYS) -> Column:
    """Drop blank and tracking parameters, keep the order of the rest."""
    parts = F.transform(
        F.split(query, "&"),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            _after(p, "=").alias("value"),
        ),
    )
    kept = F.filter(
        parts,
        lambda p: (p["value"] != "") & ~p["key"].isin(*ignored) & ~F.startswith(p["key"], F.lit("utm_")),
    )
    encoded = F.transform(kept, lambda p: F.concat(_recode(p["key"]), F.lit("="), _recode(p["value"])))
    return F.when(query == "", F.lit("")).otherwise(F.array_join(encoded, "&"))


def canonical_url(
    c: Column,
    ignored: Iterable[str] = lx.TRACKING_KEYS,
    keep_case: bool = False,
    http_only: bool = False,
) -> Column:
    """Identity form of a URL.

    Scheme and host are lower-cased (unless ``keep_case``), an empty path becomes
    ``/``, tracking parameters and the fragment go. Text that is not an absolute
    URL comes back trimmed; NULL comes back as the empty string.
    """

    def rebuild(value: Column, part: Column) -> Column:
        scheme, netloc = part["scheme"], part["netloc"]
        if not keep_case:
            scheme, netloc = F.lower(scheme), F.lower(netloc)
        question = tx.let(
            clean_query(part["query"], ignored),
            lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)),
        )
        rebuilt = F.concat(
            scheme, F.lit("://"), netloc, F.when(part["path"] == "", F.lit("/")).otherwise(part["path"]), question
        )
        absolute = part["scheme"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*$") & (part["netloc"] != "")
        if http_only:
            absolute = absolute & tx.starts_any(value, ("http://", "https://"))
        return F.when(absolute, rebuilt).otherwise(value)

    return tx.let(tx.strip(tx.text_or_empty(c)), lambda v: tx.let(parts(v), lambda p: rebuild(v, p)))


def match_url(c: Column) -> Column:
    """URL without fragment; one site also loses its share parameters."""
    share = ("shareRedId=", "apptime=", "share_id=", "author_share=")

    def body(value: Column, part: Column) -> Column:
        kept = F.array_join(
            F.filter(F.split(part["query"], "&"), lambda p: (p != "") & ~tx.starts_any(p, share)), "&"
        )
        query = F.when(F.endswith(part["netloc"], F.lit("xiaohongshu.com")), kept).otherwise(part["query"])
        base = F.substring_index(F.substring_index(value, "#", 1), "?", 1)
        return tx.let(query, lambda q: F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))

    return with_parts(c, body)


def path_key(c: Column) -> Column:
    """(host, path without trailing slash) as one text key."""

    def body(_: Column, part: Column) -> Column:
        trimmed = F.rtrim(part["path"], F.lit("/"))
        return F.concat(part["netloc"], F.when(trimmed == "", F.lit("/")).otherwise(trimmed))

    return with_parts(c, body)


def _note_page(url: Column) -> Column:
    """Explore page of the note site, NULL when the URL names no note."""
    prefix = F.lit("https://www.xiaohongshu.com/explore/")

    def body(_: Column, part: Column) -> Column:
        note = F.regexp_extract(part["path"], r"(?i)/(?:explore|discovery/item)/([0-9a-z]{16,24})", 1)
        target = F.regexp_extract(part["query"], r"(?:^|&)target_note_id=([^&]+)", 1)
        page = (
            F.when(note != "", F.concat(prefix, note))
            .when(target != "", F.concat(prefix, target))
            .when(
                F.startswith(part["path"], F.lit("/explore/")),
                F.concat(F.lit("https://www.xiaohongshu.com"), part["path"]),
            )
        )
        return F.when(F.contains(F.lower(part["netloc"]), F.lit("xiaohongshu.com")), page)

    return with_parts(url, body)


def platform_url(c: Column) -> Column:
    """Canonical page of the two video platforms with several URL forms."""

    def body(value: Column, part: Column) -> Column:
        low = F.lower(value)
        video_id = F.regexp_extract(value, r"(?i)\b(BV[0-9A-Za-z]{10,})\b", 1)
        redirect = F.coalesce(
            F.try_url_decode(F.regexp_extract(part["query"], r"(?:^|&)redirectPath=([^&]+)", 1)), F.lit("")
        )
        login = F.startswith(part["path"], F.lit("/login"))
        note = tx.let(
            redirect,
            lambda r: F.when(login & (r != ""), _note_page(r)).otherwise(_note_page(value)),
        )
        on_video_site = tx.contains_any(low, ("bilibili.com", "b23.tv"))
        return (
            F.when(on_video_site & (video_id != ""), F.concat(F.lit("https://www.bilibili.com/video/"), video_id))
            .when(F.contains(low, F.lit("xiaohongshu.com")), F.coalesce(note, value))
            .otherwise(value)
        )

    return with_parts(c, body)


OWNER, REPO = r"^[A-Za-z0-9_.\-]{1,39}$", r"^[A-Za-z0-9_.\-]{1,100}$"


def _code_host_steps(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(path steps)`` for URLs on the code host, else NULL."""

    def on_host(_: Column, part: Column) -> Column:
        steps = F.filter(F.split(part["path"], "/"), lambda p: p != "")
        return F.when(F.contains(F.lower(part["netloc"]), F.lit("github.com")), tx.let(steps, body))

    return with_parts(c, on_host)


def _step(steps: Column, i: int) -> Column:
    return F.try_element_at(steps, F.lit(i))


def repo_of(c: Column) -> Column:
    """``owner/repo`` of a code-host URL, NULL when it has none."""

    def body(steps: Column) -> Column:
        owner = tx.strip(_step(steps, 1))
        repo = F.regexp_replace(tx.strip(_step(steps, 2)), r"\.git$", "")
        return F.when(owner.rlike(OWNER) & repo.rlike(REPO), F.concat(owner, F.lit("/"), repo))

    return _code_host_steps(c, body)


def blob_of(c: Column) -> Column:
    """struct(owner, repo, branch, path) of a file URL on the code host, else NULL."""

    def body(steps: Column) -> Column:
        owner, repo = _step(steps, 1), F.regexp_replace(_step(steps, 2), r"\.git$", "")
        file_path = F.array_join(F.slice(steps, 5, F.greatest(F.size(steps) - 4, F.lit(0))), "/")
        valid = (
            (F.size(steps) >= 5) & F.lower(_step(steps, 3)).isin("blob", "raw") & owner.rlike(OWNER) & repo.rlike(REPO)
        )
        return F.when(
            valid,
            F.struct(
                owner.alias("owner"), repo.alias("repo"), _step(steps, 4).alias("branch"), file_path.alias("path")
            ),
        )

    return _code_host_steps(c, body)


def family(c: Column, doc_hosts: Iterable[str] = lx.DOC_HOSTS) -> Column:
    low = F.lower(c)
    return (
        F.when(tx.contains_any(low, ("bilibili.com", "b23.tv")), F.lit("bilibili"))
        .when(F.contains(low, F.lit("xiaohongshu.com")), F.lit("xiaohongshu"))
        .when(tx.contains_any(low, ("youtube.com", "youtu.be")), F.lit("youtube"))
        .when(F.contains(low, F.lit("github.com")), F.lit("github"))
        .when(tx.contains_any(low, doc_hosts), F.lit("docs"))
        .otherwise(F.lit("web"))
    )


def source_kind(c: Column, explicit: Column | None = None) -> Column:
    inferred = F.when(tx.contains_any(F.lower(c), lx.VIDEO_URL_TOKENS), F.lit("video_url")).otherwise(F.lit("url"))
    if explicit is None:
        return inferred
    return F.when(explicit.isin("url", "video_url"), explicit).otherwise(inferred)


def bucket(c: Column, kind: Column, doc_hosts: Iterable[str] = lx.DOC_HOSTS) -> Column:
    fam, low = family(c, doc_hosts), F.lower(c)
    return (
        F.when(
            fam == "github",
            F.when(F.contains(low, F.lit("/blob/")), F.lit("github_doc")).otherwise(F.lit("github_repo")),
        )
        .when(fam == "docs", F.lit("docs_web"))
        .when((fam == "web") & F.contains(low, F.lit("cloud.tencent.com")), F.lit("tutorial_web"))
        .when(kind == "video_url", F.concat(fam, F.lit("_video")))
        .otherwise(F.concat(fam, F.lit("_page")))
    )


def video_provider(c: Column) -> Column:
    """Known provider key inside the host, else the host, else NULL."""

    def body(name: Column) -> Column:
        known = F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(k)) for k in lx.VIDEO_PROVIDERS])
        return F.when(name != "", F.coalesce(known, name))

    return tx.let(host(c), body)


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` as seen from page ``base``."""

    def relative(part: Column, ref: Column) -> Column:
        folder = F.regexp_replace(part["path"], r"[^/]*$", "")
        joined = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref)
        joined = F.regexp_replace(joined, r"/(?:\./)+", "/")
        for _ in range(4):
            joined = F.regexp_replace(joined, r"/[^/.][^/]*/\.\./", "/")
        return F.regexp_replace(joined, r"^(?:/\.\.)+/", "/")

    def body(value: Column, part: Column, ref: Column) -> Column:
        origin = F.concat(part["scheme"], F.lit("://"), part["netloc"])
        return (
            F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(F.startswith(ref, F.lit("//")), F.concat(part["scheme"], F.lit(":"), ref))
            .when(F.startswith(ref, F.lit("/")), F.concat(origin, ref))
            .when(F.startswith(ref, F.lit("?")), F.concat(origin, part["path"], ref))
            .when(ref == "", value)
            .otherwise(F.concat(origin, relative(part, ref)))
        )

    return tx.let(tx.strip(link), lambda ref: with_parts(base, lambda v, p: body(v, p, ref)))
