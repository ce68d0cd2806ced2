"""Rows out of the JSON of forges, package registries, scrapers and search services.

Bodies are parsed once into a VARIANT; every field is a path into it, alternatives
coalesced in order. Text that does not parse gives null fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions.markup import clean_inline_udf, decode_entities
from textmill.functions.structure import structs
from textmill.functions.text import _col, slugify
from textmill.functions.urls import canonicalize_url
from textmill.operators.cuts import dropped, written

import re

CLIP = 1200


def json_of(c: Column | str) -> Column:
    return F.try_parse_json(_col(c))


def field(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first of several paths that has a value of the type."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def _items(v: Column, *paths: str) -> Column:
    """The objects of the first path that holds a list; other elements, JSON nulls among them, are left out."""
    listed = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths], F.array().cast("array<variant>"))
    return F.filter(listed, lambda x: x.isNotNull() & F.schema_of_variant(x).startswith("OBJECT"))


def _labels(item: Column) -> Column:
    raw = F.coalesce(F.try_variant_get(item, "$.labels", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(raw, lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$", "string"))), lambda s: s.isNotNull())


def forge_items(body: Column | str, kind: str, forge: str = "github") -> Column:
    """Issues or pull requests of a search answer: ``ARRAY<STRUCT<kind, number, title, url, state, labels, body, updated_at, score>>``."""
    v = json_of(body)
    listed = _items(v, "$.items", "$")
    number, url, text = ("$.iid", "$.web_url", "$.description") if forge == "gitlab" else ("$.number", "$.html_url", "$.body")

    def item(x: Column) -> Column:
        draft = F.coalesce(F.try_variant_get(x, "$.draft", "boolean"), F.lit(False)) if forge == "github" else F.lit(False)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.try_variant_get(x, number, "bigint").alias("number"),
            F.trim(F.coalesce(field(x, "$.title"), F.lit(""))).alias("title"),
            F.coalesce(field(x, url), F.lit("")).alias("url"),
            F.when(draft, F.lit("draft")).otherwise(F.coalesce(field(x, "$.state"), F.lit(""))).alias("state"),
            _labels(x).alias("labels"),
            F.substring(F.coalesce(field(x, text), F.lit("")), 1, CLIP).alias("body"),
            field(x, "$.updated_at").alias("updated_at"),
            F.try_variant_get(x, "$.score", "double").alias("score"),
        )

    return F.transform(listed, item)


def releases(body: Column | str) -> Column:
    """Releases of any forge: ``ARRAY<STRUCT<title, url, state, body, updated_at>>``."""
    return F.transform(
        _items(json_of(body), "$"),
        lambda x: F.struct(
            F.coalesce(F.nullif(F.trim(field(x, "$.name", "$.tag_name", "$.tag")), F.lit("")), field(x, "$.tag_name"), F.lit("")).alias("title"),
            F.coalesce(field(x, "$.html_url", "$.web_url"), F.lit("")).alias("url"),
            F.when(F.coalesce(F.try_variant_get(x, "$.prerelease", "boolean"), F.lit(False)), F.lit("prerelease")).otherwise(F.lit("released")).alias("state"),
            F.substring(F.coalesce(field(x, "$.body", "$.description"), F.lit("")), 1, CLIP).alias("body"),
            field(x, "$.published_at", "$.released_at", "$.created_at").alias("updated_at"),
        ),
    )


def tags(body: Column | str, web_url: Column | str) -> Column:
    return F.transform(
        _items(json_of(body), "$"),
        lambda x: F.struct(F.trim(F.coalesce(field(x, "$.name"), F.lit(""))).alias("title"), F.concat(_col(web_url), F.lit("/releases/tag/"), F.coalesce(field(x, "$.name"), F.lit(""))).alias("url")),
    )


def repo_facts(body: Column | str) -> Column:
    """One record out of the three forges' repository schemas."""
    v = json_of(body)
    return F.struct(
        field(v, "$.full_name", "$.path_with_namespace").alias("full_name"),
        field(v, "$.description").alias("description"),
        field(v, "$.homepage", "$.web_url").alias("homepage"),
        field(v, "$.license.spdx_id", "$.license.name").alias("license"),
        field(v, "$.stargazers_count", "$.star_count", kind="bigint").alias("stars"),
        field(v, "$.forks_count", kind="bigint").alias("forks"),
        field(v, "$.open_issues_count", kind="bigint").alias("open_issues"),
        field(v, "$.default_branch").alias("default_branch"),
        field(v, "$.pushed_at", "$.last_activity_at").alias("pushed_at"),
        F.try_variant_get(v, "$.archived", "boolean").alias("archived"),
        F.coalesce(F.try_variant_get(v, "$.topics", "array<string>"), F.try_variant_get(v, "$.tag_list", "array<string>"), F.array().cast("array<string>")).alias("topics"),
    )


def forge_kind(host: Column | str) -> Column:
    h = F.lower(_col(host))
    return F.when(h.rlike(r"(^|\.)github\.com$"), "github").when(h.contains("gitlab"), "gitlab").when(h.rlike(r"gitea|codeberg|forgejo"), "gitea")


def last_names(renames: DataFrame) -> DataFrame:
    """``name, last`` of ``renames(name, to)``: where a chain of renames ends, however long; null where it runs in a circle.

    Pointer jumping: each round doubles the steps behind a pointer, so a chain
    of n renames takes log2(n) joins. Of several renames of one name the least
    counts; one to itself is none. Both sides of a join are shuffled: files of
    names are a fraction of their rows, so by their size Spark would tell them
    to all tasks through the driver.
    """
    steps = renames.where("name is not null and to is not null and name <> to").groupBy("name").agg(F.min("to").alias("to"))
    jumps = written(steps.withColumn("open", F.lit(True)), "renames")
    names, done = jumps.count(), 1
    while done <= names and not jumps.where("open").isEmpty():
        further = jumps.select(F.col("name").alias("to"), F.col("to").alias("next"), F.col("open").alias("goes_on"))
        joined = jumps.where("open").join(further.hint("merge"), "to", "left")
        moved = joined.select("name", F.coalesce("next", "to").alias("to"), F.coalesce("goes_on", F.lit(False)).alias("open"))
        last, jumps = jumps, written(jumps.where(~F.col("open")).unionByName(moved), "renames")
        dropped(last)
        done *= 2
    return jumps.select("name", F.when(~F.col("open"), F.col("to")).alias("last"))


def canonical_repos(refs: DataFrame, renames: DataFrame) -> DataFrame:
    """``refs(owner, repo)`` with ``canonical``, the end of their chain in ``renames(owner, repo, full_name)``; their own name where there is none."""
    slug = F.concat_ws("/", "owner", "repo")
    ends = last_names(renames.select(slug.alias("name"), F.col("full_name").alias("to")))
    return refs.withColumn("_slug", slug).join(ends.hint("merge"), F.col("_slug") == F.col("name"), "left").withColumn("canonical", F.coalesce("last", "_slug")).drop("_slug", "name", "last")


# -- package registries -------------------------------------------------------------------------

REGISTRIES = ("npm", "pypi", "crates")


def normalize_repo_url(c: Column | str) -> Column:
    s = F.trim(_col(c))
    for pattern, to in ((r"^git\+", ""), (r"^git://", "https://"), (r"^ssh://git@", "https://"), (r"^git@([^:]+):", "https://$1/"), (r"\.git$", "")):
        s = F.regexp_replace(s, pattern, to)
    s = F.when(s.rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), s)).otherwise(s)
    return F.when(s.rlike("(?i)^https?://"), s)


def _member(v: Column, path: str, key: Column) -> Column:
    """A member of an object under a name that is data."""
    return F.try_element_at(F.try_variant_get(v, path, "map<string,variant>"), key)


def package_facts(packages: DataFrame, body: str = "body", registry: str = "registry", version: Column | None = None) -> DataFrame:
    """Registry answers to facts: ``name, version, description, homepage, repository, license, deprecated, downloads, published_at`` appended.

    One projection serves all three registries: each field's paths are tried
    within the row's own registry.
    """
    p = packages.withColumn("_v", json_of(body))
    v, of = F.col("_v"), lambda r, value: F.when(F.col(registry) == r, value)
    wanted = version if version is not None else F.lit(None).cast("string")
    p = p.withColumn("_version", F.coalesce(of("npm", F.coalesce(wanted, field(v, "$['dist-tags'].latest"))), of("pypi", field(v, "$.info.version")), of("crates", F.coalesce(wanted, field(v, "$.crate.max_stable_version", "$.crate.newest_version")))))
    p = p.withColumn("_npm", of("npm", _member(v, "$.versions", F.col("_version"))))
    n = F.col("_npm")
    repo = F.coalesce(
        of("npm", F.coalesce(field(n, "$.repository.url", "$.repository"), field(v, "$.repository.url", "$.repository"))),
        of("pypi", field(v, "$.info.project_urls.Source", "$.info.project_urls.Repository", "$.info.project_urls['Source Code']", "$.info.project_urls.Code", "$.info.home_page")),
        of("crates", field(v, "$.crate.repository")),
    )
    files = F.try_variant_get(v, "$.urls", "array<variant>")
    yanked = (F.size(files) > 0) & F.forall(files, lambda f: F.coalesce(F.try_variant_get(f, "$.yanked", "boolean"), F.lit(False)))
    return p.select(
        *packages.columns,
        F.coalesce(of("npm", field(v, "$.name")), of("pypi", field(v, "$.info.name")), of("crates", field(v, "$.crate.name"))).alias("name"),
        F.col("_version").alias("version"),
        F.coalesce(of("npm", F.coalesce(field(n, "$.description"), field(v, "$.description"))), of("pypi", field(v, "$.info.summary")), of("crates", field(v, "$.crate.description"))).alias("description"),
        F.coalesce(
            of("npm", F.coalesce(field(n, "$.homepage"), field(v, "$.homepage"))),
            of("pypi", F.coalesce(F.nullif(field(v, "$.info.home_page"), F.lit("")), field(v, "$.info.project_urls.Homepage", "$.info.project_urls.homepage"))),
            of("crates", field(v, "$.crate.homepage")),
        ).alias("homepage"),
        normalize_repo_url(repo).alias("repository"),
        F.coalesce(of("npm", field(n, "$.license", "$.license.type")), of("pypi", F.nullif(field(v, "$.info.license"), F.lit("")))).alias("license"),
        F.coalesce(of("npm", F.when(F.try_variant_get(n, "$.deprecated", "boolean"), "deprecated").otherwise(F.nullif(field(n, "$.deprecated"), F.lit("false")))), of("pypi", F.when(yanked, "every file for this release is yanked"))).alias("deprecated"),
        of("crates", F.try_variant_get(v, "$.crate.downloads", "bigint")).alias("downloads"),
        F.coalesce(of("npm", F.try_variant_get(_member(v, "$.time", F.col("_version")), "$", "string")), of("crates", field(v, "$.crate.updated_at"))).alias("published_at"),
    )


def resolve_packages(facts: DataFrame, asked: str = "asked", registry: str = "registry") -> DataFrame:
    """Per asked name the facts of the first registry, in order, that knows it."""
    place = F.array_position(F.array(*[F.lit(r) for r in REGISTRIES]), F.col(registry))
    known = facts.where(F.col("name").isNotNull()).withColumn("_place", place)
    first = Window.partitionBy(asked).orderBy("_place")
    return known.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_place")


# -- repositories by any name -------------------------------------------------------------------


def resolve_repo(c: Column | str) -> Column:
    """``STRUCT<raw, host, owner, repo, clone_url, web_url, slug>`` of a clone address, web address, host path or ``owner/name``."""
    t = F.trim(_col(c))
    scp, url, path = r"^git@([^:]+):(.+)$", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+)$", r"(?i)^([a-z0-9.-]+\.[a-z]{2,})/(.+)$"
    short = t.rlike(r"^[\w.-]+/[\w.-]+$")
    got = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(t, p, k), F.lit("")) for p in (scp, url, path)])
    host = F.coalesce(F.lower(got(1)), F.when(short, F.lit("github.com")))
    full = F.regexp_replace(F.regexp_replace(F.coalesce(got(2), F.when(short, t)), r"\.git$", ""), "/+$", "")
    parts = F.filter(F.split(full, "/"), lambda s: s != "")
    owner = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    base = F.when(t.rlike("(?i)^https?://") | t.rlike(scp), F.regexp_replace(t, "/+$", "")).otherwise(F.concat(F.lit("https://"), host, F.lit("/"), full, F.lit(".git")))
    clone = F.when(base.endswith(".git"), base).otherwise(F.concat(base, F.lit(".git")))
    generic = F.struct(
        t.alias("raw"), F.lit("generic").alias("host"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("repo"),
        F.lit(None).cast("string").alias("clone_url"), F.lit(None).cast("string").alias("web_url"), slugify(t, fallback="seed").alias("slug"),
    )
    named = F.struct(
        t.alias("raw"), host.alias("host"), owner.alias("owner"), F.try_element_at(parts, F.lit(-1)).alias("repo"),
        clone.alias("clone_url"), F.concat(F.lit("https://"), host, F.lit("/"), full).alias("web_url"), slugify(F.concat(host, F.lit("/"), full)).alias("slug"),
    )
    return F.when(host.isNull(), generic).otherwise(named)


def same_commit(a: Column | str, b: Column | str) -> Column:
    """Equal, or one is a prefix of the other with 7 characters or more."""
    a, b = _col(a), _col(b)
    prefix = (F.least(F.length(a), F.length(b)) >= 7) & (F.startswith(a, b) | F.startswith(b, a))
    return F.coalesce((a == b) | prefix, F.lit(False)) & F.coalesce(a != "", F.lit(False))


# -- search answers -----------------------------------------------------------------------------

ENGINES = ("ddg", "ddglite", "mojeek")
# The anchor and snippet of a result on each engine's pages, and the engine's own addresses.
_PAGES = {
    "ddg": (r"<a\b([^>]*\bresult__a\b[^>]*)>", r"class=\"result__snippet\"[^>]*>([\s\S]*?)</a>", "duckduckgo.com"),
    "ddglite": (r"<a\b([^>]*\bresult-link\b[^>]*)>", r"class=\"result-snippet\"[^>]*>([\s\S]*?)</td>", "duckduckgo.com"),
    "mojeek": (r"<a\b([^>]*\bclass=\"[^\"]*\btitle\b[^\"]*\"[^>]*)>", r"<p\b[^>]*\bclass=\"[^\"]*\bs\b[^\"]*\"[^>]*>([\s\S]*?)</p>", "mojeek.com"),
}


def strip_tags(s: str) -> str:
    return re.sub(r"\s+", " ", decode_entities(re.sub(r"<[^>]+>", " ", s))).strip()


def redirect_target(href: str) -> str:
    """Where a search engine's redirect link leads."""
    from urllib.parse import unquote

    m = re.search(r"[?&]uddg=([^&]+)", href)
    return unquote(m[1]) if m else f"https:{href}" if href.startswith("//") else href


@structs("array<struct<url:string,title:string,snippet:string>>")
def result_hits(page: str, engine: str) -> list[dict]:
    """The results on a stored result page; advertisements and the engine's own links left out."""
    anchor, snippet, own = _PAGES[engine]
    marks = list(re.finditer(anchor, page, re.I))
    out = []
    for m, until in zip(marks, [*(n.start() for n in marks[1:]), len(page)]):
        title, closed, rest = page[m.end() : until].partition("</a>")
        href = re.search(r"\bhref=\"([^\"]+)\"", m[1])
        url = redirect_target(href[1]) if href else ""
        if closed and re.match("https?://", url) and own not in url:
            said = re.search(snippet, rest, re.I)
            out.append({"url": url, "title": strip_tags(title) or url, "snippet": strip_tags(said[1]) if said else ""})
    return out


def looks_like_challenge(body: Column | str) -> Column:
    """A short page that asks for proof of a human."""
    head = F.lower(F.substring(_col(body), 1, 4000))
    return (F.length(_col(body)) <= 40_000) & head.rlike(r"<title>[^<]*captcha|anomaly-modal|/anomaly\.js|captcha-wrap|sending automated queries")


def scrape_record(body: Column | str) -> Column:
    """``STRUCT<markdown, title, source_url, status_code>`` of a scraper's answer; null when it has no markdown."""
    v = json_of(body)
    markdown = field(v, "$.data.markdown", "$.markdown")
    ok = F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(True)) & (F.trim(F.coalesce(markdown, F.lit(""))) != "")
    return F.when(
        ok,
        F.struct(
            markdown.alias("markdown"),
            field(v, "$.data.metadata.title", "$.metadata.title").alias("title"),
            field(v, "$.data.metadata.sourceURL", "$.data.metadata.url").alias("source_url"),
            F.try_variant_get(v, "$.data.metadata.statusCode", "int").alias("status_code"),
        ),
    )


def search_records(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per hit of a search answer in any of its three shapes: ``pos, url, title, description`` appended."""
    v = json_of(body)
    failed = F.coalesce(~F.try_variant_get(v, "$.success", "boolean"), F.lit(False))
    hits = F.filter(_items(v, "$.data", "$.data.web", "$.data.results", "$.results"), lambda x: F.coalesce(field(x, "$.url"), F.lit("")) != "")
    rows = df.select("*", F.posexplode(F.when(failed, F.array().cast("array<variant>")).otherwise(hits)).alias("pos", "_x"))
    x = F.col("_x")
    return rows.select(
        *df.columns,
        "pos",
        field(x, "$.url").alias("url"),
        clean_inline_udf(F.coalesce(F.nullif(field(x, "$.title"), F.lit("")), field(x, "$.url"))).alias("title"),
        F.substring(clean_inline_udf(F.coalesce(field(x, "$.description", "$.snippet", "$.content"), F.lit(""))), 1, 360).alias("description"),
    )


def paged_hits(hits: DataFrame, limit: int = 10) -> DataFrame:
    """Hits of result pages ``(query, page, pos, url, ...)`` as one scan would list them: first of each canonical address, pages read until one adds nothing, at most ``limit``."""
    canon = hits.withColumn("_key", canonicalize_url("url"))
    first = canon.withColumn("_rn", F.row_number().over(Window.partitionBy("query", "_key").orderBy("page", "pos"))).withColumn("_new", F.col("_rn") == 1)
    pages = first.groupBy("query", "page").agg(F.bool_or("_new").alias("adds"))
    stop = pages.where(~F.col("adds")).groupBy("query").agg(F.min("page").alias("_stop"))
    kept = first.where("_new").join(stop, "query", "left").where(F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))
    place = F.row_number().over(Window.partitionBy("query").orderBy("page", "pos"))
    return kept.withColumn("place", place).where(F.col("place") <= limit).drop("_key", "_rn", "_new", "_stop")


def cascade(hits: DataFrame, query: str = "query", rung: str = "rung") -> DataFrame:
    """Of each query only the hits of its first rung that has any."""
    return hits.withColumn("_first", F.min(rung).over(Window.partitionBy(query))).where(F.col(rung) == F.col("_first")).drop("_first")
