"""Languages, regions and providers of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import _col

# The country of a language, and names that a search engine spells differently.
COUNTRY_OF = {
    "en": "us", "pt": "br", "ja": "jp", "zh": "cn", "ko": "kr", "sv": "se", "da": "dk", "cs": "cz", "el": "gr",
    "nb": "no", "nn": "no", "uk": "ua", "ar": "xa", "he": "il", "hi": "in",
}
REGION_ALIAS = {"gb": "uk", "en": "us"}
LANGUAGE_ALIAS = {"nb": "no", "nn": "no", "ja": "jp"}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def base_lang(lang: Column | str) -> Column:
    return F.lower(F.split_part(F.coalesce(F.nullif(_col(lang), F.lit("")), F.lit("en")), F.lit("-"), F.lit(1)))


def resolve_region(lang: Column | str, region: Column | None = None) -> Column:
    """The region asked for, else that of the language tag, else the language's country."""
    given = F.nullif(F.lower(F.trim(region)), F.lit("")) if region is not None else F.lit(None).cast("string")
    tagged = F.nullif(F.lower(F.split_part(F.coalesce(_col(lang), F.lit("")), F.lit("-"), F.lit(2))), F.lit(""))
    return F.coalesce(given, tagged, _looked_up(COUNTRY_OF, base_lang(lang)))


def search_region(lang: Column | str, region: Column | None = None) -> Column:
    return F.concat_ws("-", _looked_up(REGION_ALIAS, resolve_region(lang, region)), _looked_up(LANGUAGE_ALIAS, base_lang(lang)))


def accept_language(lang: Column | str, region: Column | None = None) -> Column:
    base = base_lang(lang)
    head = F.concat(base, F.lit("-"), F.upper(resolve_region(lang, region)), F.lit(","), base, F.lit(";q=0.9"))
    return F.when(base == "en", head).otherwise(F.concat(head, F.lit(",en;q=0.5")))


_ABSTRACT = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&id={}&rettype=abstract&retmode=text"


def pubmed_abstract_url(pmid: Column | str) -> Column:
    before, after = _ABSTRACT.split("{}")
    return F.concat(F.lit(before), _col(pmid).cast("string"), F.lit(after))


def resolve_provider(url: Column | str) -> Column:
    """``STRUCT<cite_url, text_url, reject, prefer_text>``: the page to cite and the address to read for scholarly addresses."""
    u = F.trim(_col(url))
    none = F.lit(None).cast("string")
    got = lambda p, k=1: F.nullif(F.regexp_extract(u, p, k), F.lit(""))
    row = lambda cite, text=none, reject=none, prefer=False: F.struct(cite.alias("cite_url"), text.alias("text_url"), reject.alias("reject"), F.lit(prefer).alias("prefer_text"))
    landing = lambda pmid: F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))
    pmid = got(r"(?i)^https?://(?:www\.)?pubmed\.ncbi\.nlm\.nih\.gov/(\d{4,9})/?$")
    pmc = got(r"(?i)^https?://(?:www\.)?pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC\d+)/?$")
    op = F.lower(got(r"(?i)^https?://eutils\.ncbi\.nlm\.nih\.gov/entrez/eutils/([a-z]+)\.fcgi"))
    arxiv = got(r"(?i)^https?://(?:www\.|export\.)?arxiv\.org/pdf/([^?#]+?)(?:\.pdf)?/?$")
    param = lambda name: F.try_url_decode(F.call_function("try_parse_url", u, F.lit("QUERY"), F.lit(name)))
    db = F.lower(param("db"))
    first = F.get(F.filter(F.split(param("id"), r"[,\s+]+"), lambda s: s != ""), F.lit(0))
    number = F.when(first.rlike("(?i)^pmc"), F.upper(first)).otherwise(F.concat(F.lit("PMC"), first))
    article = lambda x: F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), x, F.lit("/"))
    query = F.concat(u, F.lit(" is an E-utilities "), op, F.lit(" query, not a document — fetch the record it points at instead."))
    return (
        F.when(pmid.isNotNull(), row(landing(pmid), pubmed_abstract_url(pmid)))
        .when(pmc.isNotNull(), row(article(F.upper(pmc))))
        .when(op.isin("esearch", "egquery", "espell"), row(u, reject=query))
        .when(op.isNotNull() & (db == "pubmed") & first.rlike(r"^\d+$"), row(landing(first), pubmed_abstract_url(first)))
        .when(op.isNotNull() & (db == "pmc") & first.isNotNull(), row(article(number)))
        .when(arxiv.isNotNull() & op.isNull(), row(F.concat(F.lit("https://arxiv.org/abs/"), arxiv), u, prefer=True))
        .otherwise(row(u))
    )


def compare_tags(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 of two ``vX.Y.Z`` tags, compared number by number."""
    nums = lambda c: F.transform(F.split(F.regexp_replace(_col(c), "^v", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("bigint"), F.lit(0)))
    pairs = F.zip_with(nums(a), nums(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    return F.coalesce(F.get(F.filter(pairs, lambda s: s != 0), F.lit(0)), F.lit(0)).cast("int")
