"""URL and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def bare_path(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), r"/+$", "")


def canonical_url(url: Column) -> Column:
    """No fragment, no tracking parameters, no www., no slash at the end; what can't be parsed stays."""
    kept = F.array_join(F.filter(F.split(part(url, "QUERY"), "&"), lambda p: ~p.rlike("(?i)^(utm_|fbclid|gclid)")), "&")
    path = F.coalesce(F.nullif(bare_path(url), F.lit("")), F.lit("/"))
    query = F.when(F.coalesce(kept, F.lit("")) == "", "").otherwise(F.concat(F.lit("?"), kept))
    return F.when(part(url, "HOST").isNull(), url).otherwise(F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), host(url), path, query))


def document_slug(url: Column) -> Column:
    """An id from the host without www. and its last label, and the path."""
    labels = F.split(host(url), r"\.")
    name = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 1), "-")).otherwise(host(url))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat(name, F.coalesce(part(url, "PATH"), F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.char_length(slug) > 80, F.regexp_replace(F.right(slug, F.lit(80)), "^-+", "")).otherwise(slug)


def scheme_less_url(url: Column) -> Column:
    """The stand-alone scorer's form."""
    query = F.coalesce(F.concat(F.lit("?"), part(url, "QUERY")), F.lit(""))
    return F.when(part(url, "HOST").isNull(), F.lower(url)).otherwise(F.lower(F.concat(host(url), bare_path(url), query)))


def bare_url(url: Column) -> Column:
    """U4: the canonical form without its scheme."""
    return F.regexp_replace(canonical_url(url), "^https?://", "")


# Links that are noise, and hosts of papers.
NOISE_PATH = (
    r"(?i)/(log-?in|sign-?in|sign-?up|register|my-?account|account|subscribe|newsletter|privacy(?:-policy)?|terms(?:-of-(?:service|use))?|\bt(?:o|and)c\b|cookies?(?:-policy)?"
    r"|about(?:-us)?|contact(?:-us)?|advertis(?:e|ing)|careers?|jobs?|search|tags?|categor(?:y|ies)|authors?)(?:/|$|\?)"
)
NOISE_HOST = r"(?i)(^|\.)(facebook|twitter|x|instagram|linkedin|pinterest|reddit|whatsapp|t\.me|tiktok|snapchat)\.com$|(^|\.)t\.me$"
ASSET = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|bmp|css|js|mjs|woff2?|ttf|eot|mp4|mp3|avi|mov|webm|zip)(\?|#|$)"
PAPER_SITES = ["arxiv.org", "semanticscholar.org", "doi.org"]
PAPER_HOSTS = ["dl.acm.org", "ieeexplore.ieee.org", "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "aclanthology.org", "openreview.net", "biorxiv.org", "medrxiv.org"]
TRUSTED_HOST = r"(?i)(^|\.)(gov|edu)$|\.ac\.[a-z]{2}$|(^|\.)courtlistener\.com$"
LISTING_PATH = r"(?i)/(category|categories|tag|tags|topic|topics|search|archive|archives|author|page/\d+)(/|$)"


def _at(h: Column, site: str) -> Column:
    return (h == site) | h.endswith(f".{site}")


def classify_link(url: Column) -> Column:
    """Doi, arxiv, outbound_link, or null for noise."""
    h, p = F.lower(part(url, "HOST")), F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    return (
        F.when(h.isNull() | ~url.rlike("(?i)^https?:") | h.rlike(NOISE_HOST) | p.isin("", "/") | p.rlike(NOISE_PATH) | p.rlike(ASSET), F.lit(None))
        .when(_at(h, "doi.org"), "doi")
        .when(_at(h, "arxiv.org"), "arxiv")
        .otherwise("outbound_link")
    )


def host_bonus(url: Column) -> Column:
    """U6."""
    return F.when(F.coalesce(part(url, "HOST").rlike(TRUSTED_HOST), F.lit(False)), 0.3).otherwise(0.0)


def listing_penalty(url: Column) -> Column:
    searched = F.coalesce(F.concat(F.lit("&"), part(url, "QUERY")).rlike("&s(=|&|$)"), F.lit(False))
    return F.when(F.coalesce(part(url, "PATH").rlike(LISTING_PATH), F.lit(False)) | searched, 1).otherwise(0)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def normalize_doi(value: Column) -> Column:
    """U7."""
    v = F.trim(F.coalesce(value, F.lit("")))
    doi = F.coalesce(_found(v, r"(?iu)(?:https?://(?:dx\.)?doi\.org/|doi\s*[:=]?\s*)(10\.\d{4,9}/[\w.()/:;-]+)"), F.when(v.startswith("10."), v))
    return F.lower(F.regexp_replace(doi, r"[)>.,;]+$", ""))


def normalize_arxiv(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    found = F.coalesce(_found(v, r"(?i)(?:arxiv(?:\.org/(?:abs|pdf)/|\s*[:=]?))(\d{4}\.\d{4,5}(?:v\d+)?)"), F.when(v.rlike(r"^\d{4}\.\d{4,5}(?:v\d+)?$"), v))
    return F.regexp_replace(found, r"v\d+$", "")


def paper_id_of_url(value: Column) -> Column:
    return F.lower(_found(F.coalesce(value, F.lit("")), r"(?i)semanticscholar\.org/paper/[^/]+/([a-f0-9]{40})"))


def is_scholarly(url: Column) -> Column:
    """U8."""
    h = F.lower(part(url, "HOST"))
    found = h.isin(*PAPER_HOSTS)
    for site in PAPER_SITES:
        found = found | _at(h, site)
    return F.coalesce(found, F.lit(False))


def paper_identity(url: Column, text: Column, title: Column, authors: Column) -> Column:
    """struct(method, value) of the first rule that applies: DOI, paper id, arXiv id, scholarly host, title with authors."""
    doi = F.coalesce(normalize_doi(url), normalize_doi(F.concat(url, F.lit("\n"), F.coalesce(text, F.lit("")))))
    named = (F.char_length(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}]+", " "))) >= 12) & (F.coalesce(F.size(authors), F.lit(0)) > 0)
    pair = lambda method, value: F.struct(F.lit(method).alias("method"), value.alias("value"))
    return F.coalesce(
        F.when(doi.isNotNull(), pair("doi", doi)),
        F.when(paper_id_of_url(url).isNotNull(), pair("semantic_scholar_paper_id", paper_id_of_url(url))),
        F.when(normalize_arxiv(url).isNotNull(), pair("arxiv", normalize_arxiv(url))),
        F.when(is_scholarly(url), pair("scholarly_url", url)),
        F.when(named, pair("title_author", title)),
    )


def lookup_terms(url: Column) -> Column:
    """The host's first label and the path's words of over two letters, for a source without a title."""
    terms = F.filter(F.split(F.lower(F.coalesce(part(url, "PATH"), F.lit(""))), "[^a-z0-9]+"), lambda w: F.char_length(w) > 2)
    return F.concat_ws(" ", host(url), F.array_join(terms, " "))


def _encoded(path: Column) -> Column:
    """What no URL may hold is written by its bytes."""
    return F.array_join(F.transform(F.split(path, ""), lambda c: F.when((F.ascii(c) > 126) | c.rlike(r'[\s"<>`{}]'), F.regexp_replace(F.url_encode(c), r"\+", "%20")).otherwise(c)), "")


def resolve(base: Column, href: Column) -> Column:
    """The http(s) URL that a link of the page at base leads to; null for others."""
    h = F.regexp_replace(F.trim(href), r"[\t\n\r]", "")
    origin = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    path = F.coalesce(F.nullif(part(base, "PATH"), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), part(base, "QUERY")), F.lit(""))
    whole = (
        F.when(h.rlike("(?i)^https?://"), h)
        .when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(h.startswith("//"), F.concat(part(base, "PROTOCOL"), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path, h))
        .when((h == "") | h.startswith("#"), F.concat(origin, path, query, h))
        .otherwise(F.concat(origin, F.regexp_replace(path, r"[^/]*$", ""), h))
    )
    pattern = r"(?is)^(https?://[^/?#]*)([^?#]*)(.*)$"
    steps = F.aggregate(
        F.split(F.regexp_extract(whole, pattern, 2), "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, s)),
    )
    plain = F.concat(F.regexp_extract(whole, pattern, 1), F.array_join(steps, "/"), F.regexp_extract(whole, pattern, 3))
    return F.when(whole.isNotNull() & (F.regexp_extract(whole, pattern, 1) != ""), _encoded(F.regexp_replace(plain, "#.*$", "")))
