"""One query for each scalar operator, over the whole table that it fits, and its DuckDB twin.

Each entry: name, table, key columns, the Spark expression, the DuckDB expression.  Arrays are joined with | so that values
compare as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import dates, maths, text, urls
from tracewell.plans import duck

c = F.col
NOW = "2026-01-01"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _joined(x: Column) -> Column:
    return F.array_join(x, "|")


_HEAD = "regexp_extract(text, '^[^\\n]*', 0)"
_DAY = "DATE '2024-01-01' + CAST((doc_id * 37) % 365 AS INTEGER)"
_WORDS = f"{duck.words('text')}"
_SHINGLED = f"array_to_string(list_sort(list_distinct({duck.grams('w', 6)})), '|')"
_GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC_WORDS)
_CLAIM = ", ".join(f"'{w}'" for w in text.CLAIM_STOPWORDS)
_UNI = rf"list_filter(string_split(regexp_replace({duck.match_key('text')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"
_FIRST_SEEN = "list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _claim_duck() -> str:
    return "array_to_string(list_filter(k, lambda w, i: list_position(k, w) = i)[1:8], '|')"


def _routes_duck(x: str) -> str:
    total = " + ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN {w} ELSE 0 END" for p, w in text.ROUTES)
    return f"CASE WHEN regexp_matches({x}, '{text.NO_ROUTE}') THEN 0 ELSE {total} END"


def _fields_duck(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{s}'" for s, p in text.FIELDS) + " END"


_LINK = f"CASE WHEN regexp_matches({duck.host('url')}, '{urls.NOISE_HOST}') OR {duck.path('url')} IN ('', '/') OR regexp_matches(lower({duck.path('url')}), '{urls.NOISE_PATH}') OR regexp_matches(lower({duck.path('url')}), '{urls.ASSET}') THEN NULL ELSE 'outbound_link' END"
_DOI_TEXT = "'see doi: 10.' || (1000 + page_id) || '/AB.' || page_id || ').'"
_FIT = "'\"' || regexp_replace(text, '[\"\\s]+', ' ', 'g') || '\"'"


def _fit_duck() -> str:
    q, inner = _FIT, "regexp_replace(text, '[\"\\s]+', ' ', 'g')"
    head = f"substring({inner}, 1, 199)"
    cut = f"trim(substring({head}, 1, greatest(CASE WHEN strpos({head}, ' ') = 0 THEN 1 ELSE length({head}) - strpos(reverse({head}), ' ') END, 1)))"
    return f"CASE WHEN length({q}) <= 200 THEN {q} ELSE '\"' || {cut} || '\"' END"


SCALARS: list[tuple[str, str, tuple[str, ...], Callable[[], Column], str]] = [
    ("t01_canonical_text", "documents", ("doc_id",), lambda: F.sha2(text.canonical_text(c("text")).cast("binary"), 256), f"sha256({duck.canonical('text')})"),
    ("t02_match_key", "documents", ("doc_id",), lambda: F.sha2(text.match_key(c("text")).cast("binary"), 256), f"sha256({duck.match_key('text')})"),
    ("t03_tokens", "documents", ("doc_id",), lambda: _joined(text.words(c("text"))), duck.list_key(_WORDS)),
    ("t04_shingles", "documents", ("doc_id",), lambda: _joined(F.array_sort(text.shingles(text.words(c("text")), 6))), _SHINGLED),
    ("t07_case_key", "benchmark", ("item_id",), lambda: text.case_key(F.concat(c("text"), F.lit(" Ab -  Cd"))), rf"regexp_replace({duck.match_key("text || ' Ab -  Cd'")}, '\s*-\s*', '-', 'g')"),
    ("t08_levenshtein", "pages", ("page_id",), lambda: text.levenshtein(c("url"), urls.canonical_url(c("url"))), f"CAST(levenshtein(url, {duck.canonical_url('url')}) AS INTEGER)"),
    ("t10_unquoted", "conversations", ("conv_id", "turn"), lambda: text.unquoted(F.concat(F.lit('"'), c("text"), F.lit('" said '), c("role"))), duck.unquoted("'\"' || text || '\" said ' || role")),
    ("t11_fingerprint_text", "documents", ("doc_id",), lambda: F.char_length(text.fingerprint_text(c("text"))), f"CAST(length(trim(regexp_replace(text, '{duck.BLANKS}', ' ', 'g'))) AS INTEGER)"),
    ("t12_content_fingerprint", "documents", ("doc_id",), lambda: text.canonical_document_id(text.content_fingerprint(c("text"))), f"'sha256:' || {duck.fingerprint('text')}"),
    ("t15_unit_key", "conversations", ("conv_id", "turn"), lambda: text.unit_key(c("text")), rf"trim(regexp_replace(regexp_replace({duck.match_key('text')}, '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"),
    ("t16_quote", "conversations", ("conv_id", "turn"), lambda: text.quote(c("text")), "'“' || CASE WHEN length(text) <= 240 THEN text ELSE rtrim(substring(text, 1, 239)) || '…' END || '”'"),
    ("t19_plain_text", "benchmark", ("item_id",), lambda: text.plain_text(c("text")), r"""trim(regexp_replace(translate(lower(text), '‘’“”"''`', ''), '\s+', ' ', 'g'))"""),
    ("t20_route_score", "conversations", ("conv_id", "turn"), lambda: text.route_score(F.concat(F.lit("Report an error: "), c("text"))), _routes_duck("'Report an error: ' || text")),
    ("t21_classify_field", "conversations", ("conv_id", "turn"), lambda: text.classify_field(F.concat(c("role"), F.lit(" message "), c("text")), F.lit(None).cast("string")), _fields_duck("role || ' message ' || text")),
    ("t22_scorer_tokens", "documents", ("doc_id",), lambda: _joined(text.scorer_words(c("text"))), duck.list_key(duck.scorer_words("text"))),
    ("t23_unicode_words", "documents", ("doc_id",), lambda: F.sha2(_joined(text.unicode_words(c("text"))).cast("binary"), 256), f"sha256({duck.list_key(_UNI)})"),
    ("t27_informative", "conversations", ("conv_id", "turn"), lambda: text.informative(c("text")), f"len(list_filter({_UNI}, lambda w: length(w) >= 3 AND w NOT IN ({_GENERIC}) AND NOT regexp_matches(w, '[0-9]'))) >= 2 OR regexp_matches(text, '[0-9]')"),
    ("t29_claim_terms", "conversations", ("conv_id", "turn"), lambda: _joined(text.claim_terms(c("text"))), _claim_duck()),
    ("t30_fit_query", "documents", ("doc_id",), lambda: text.fit_query(F.concat(F.lit('"'), F.regexp_replace("text", r'["\s]+', " "), F.lit('"'))), _fit_duck()),
    ("t33_display_title", "documents", ("doc_id",), lambda: text.display_title(F.regexp_extract("text", r"^[^\n]*", 0), F.concat(F.lit("doc:"), c("doc_id"))), f"coalesce(nullif(trim({_HEAD}), ''), 'doc:' || doc_id)"),
    ("t36_title_key", "documents", ("doc_id",), lambda: text.title_key(F.regexp_extract("text", r"^[^\n]*", 0)), rf"lower(trim(regexp_replace({_HEAD}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"),
    ("t38_proposal_label", "documents", ("doc_id",), lambda: text.proposal_label(c("source"), F.lit(" "), c("lang")), "concat_ws(' | ', nullif(trim(source), ''), nullif(trim(lang), ''))"),
    ("t39_strip_tail", "benchmark", ("item_id",), lambda: text.strip_tail(c("text")), r"regexp_replace(text, '[.,;:)\]]+$', '')"),
    ("u01_canonical_url", "pages", ("page_id",), lambda: urls.canonical_url(c("url")), duck.canonical_url("url")),
    ("u02_document_slug", "pages", ("page_id",), lambda: urls.document_slug(c("url")), duck.slug("url")),
    ("u03_scheme_less_url", "pages", ("page_id",), lambda: urls.scheme_less_url(c("url")), duck.scheme_less("url")),
    ("u04_bare_url", "pages", ("page_id",), lambda: urls.bare_url(c("url")), f"regexp_replace({duck.canonical_url('url')}, '^https?://', '')"),
    ("u05_link_kind", "pages", ("page_id",), lambda: urls.classify_link(c("url")), _LINK),
    ("u06_host_score", "pages", ("page_id",), lambda: urls.host_bonus(c("url")) - urls.listing_penalty(c("url")), f"CASE WHEN regexp_matches({duck.host('url')}, '{urls.TRUSTED_HOST}') THEN 0.3::DOUBLE ELSE 0::DOUBLE END - CASE WHEN regexp_matches({duck.path('url')}, '{urls.LISTING_PATH}') THEN 1 ELSE 0 END"),
    ("u07_paper_ids", "pages", ("page_id",), lambda: F.concat_ws("|", urls.normalize_doi(F.concat(F.lit("see doi: 10."), 1000 + c("page_id"), F.lit("/AB."), c("page_id"), F.lit(")."))), urls.normalize_arxiv(F.concat(F.lit("arXiv:2401.0"), 1000 + c("page_id") % 9000, F.lit("v2")))), "'10.' || (1000 + page_id) || '/ab.' || page_id || '|2401.0' || (1000 + page_id % 9000)"),
    ("u08_scholarly", "pages", ("page_id",), lambda: urls.is_scholarly(F.when(c("page_id") % 3 == 0, F.lit("https://export.arxiv.org/abs/1")).otherwise(c("url"))), "page_id % 3 = 0"),
    ("u09_paper_identity", "pages", ("page_id",), lambda: urls.paper_identity(F.when(c("page_id") % 3 == 0, F.lit("https://arxiv.org/abs/2401.01234v3")).otherwise(c("url")), F.lit(""), F.lit("A title of some length"), F.array(F.lit("A. Name")))["method"], "CASE WHEN page_id % 3 = 0 THEN 'arxiv' ELSE 'title_author' END"),
    ("u10_lookup_terms", "pages", ("page_id",), lambda: urls.lookup_terms(c("url")), f"{duck.host('url')} || ' ' || array_to_string(list_filter(string_split_regex(lower({duck.path('url')}), '[^a-z0-9]+'), lambda w: length(w) > 2), ' ')"),
    ("d01_named_date", "documents", ("doc_id",), lambda: dates.date_key(dates.to_time(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((c("doc_id") * 37) % 365).cast("int")), "MMMM d, yyyy"), _now())), f"strftime({_DAY}, '%Y-%m-%d')"),
    ("d02_us_date", "documents", ("doc_id",), lambda: dates.date_key(dates.us_numeric_date(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((c("doc_id") * 37) % 365).cast("int")), "MM/dd/yy"), _now())), f"CASE WHEN day({_DAY}) > 12 THEN strftime({_DAY}, '%Y-%m-%d') END"),
    ("d03_url_date", "documents", ("doc_id",), lambda: dates.date_key(dates.url_date(F.concat(F.lit("https://a.test/"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((c("doc_id") * 37) % 365).cast("int")), "yyyy/MM/dd"), F.lit("/x")), _now())), f"strftime({_DAY}, '%Y-%m-%d')"),
    ("d06_labelled_date", "documents", ("doc_id",), lambda: dates.date_key(dates.labelled_date(F.concat(F.lit("Published on: "), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((c("doc_id") * 37) % 365).cast("int")), "MMMM d, yyyy"), F.lit(" "), c("text")), _now())), f"strftime({_DAY}, '%Y-%m-%d')"),
    ("d07_gap_days", "documents", ("doc_id",), lambda: dates.gap_days(c("doc_id") * 7, c("doc_id") * c("n_chars") * 1001), duck.round3("(doc_id * n_chars * 1001 - doc_id * 7) / 86400000.0::DOUBLE")),
    ("m01_noisy_or", "documents", ("doc_id",), lambda: maths.round3(maths.noisy_or((c("doc_id") % 10) / 20, (c("n_chars") % 7) / 10, F.lit(0.05))), duck.round3("1.0::DOUBLE - 1.0::DOUBLE * (1.0::DOUBLE - (doc_id % 10) / 20.0::DOUBLE) * (1.0::DOUBLE - (n_chars % 7) / 10.0::DOUBLE) * (1.0::DOUBLE - 0.05::DOUBLE)")),
    ("m02_round3", "documents", ("doc_id",), lambda: maths.round3(c("n_chars") / 2000), duck.round3("n_chars / 2000.0::DOUBLE")),
    ("m04_rarity", "documents", ("doc_id",), lambda: maths.round3(maths.rarity(F.lit(0.35), c("n_chars") % 9)), duck.round3("0.35::DOUBLE / sqrt(greatest(1, n_chars % 9))")),
    ("m05_capped", "documents", ("doc_id",), lambda: maths.capped(0.3, (c("n_chars") % 12) * 0.05), "least(0.3::DOUBLE, (n_chars % 12) * 0.05::DOUBLE)"),
    ("s04_content_kind", "pages", ("page_id",), lambda: F.when(F.lower("html").startswith("<!doctype html"), "html").when(c("html").startswith("%PDF-"), "pdf").otherwise(F.when(urls.bare_path(c("url")).endswith(".pdf"), "pdf").otherwise("html")), "CASE WHEN lower(html) LIKE '<!doctype html%' THEN 'html' WHEN html LIKE '\\%PDF-%' ESCAPE '\\' THEN 'pdf' WHEN url LIKE '%.pdf' THEN 'pdf' ELSE 'html' END"),
]


def _query(table: str, keys: tuple[str, ...], value: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys, value().alias("value"))


QUERIES = {name: _query(table, keys, value) for name, table, keys, value, _ in SCALARS}
ORACLES: dict[str, str] = {name: f"SELECT {', '.join(keys)}, {sql} AS value FROM {table}" for name, table, keys, _, sql in SCALARS}

# A list that a lambda reads is a column of an inner query, so it is made once per row.
ORACLES["t04_shingles"] = f"SELECT doc_id, {_SHINGLED} AS value FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"
ORACLES["t29_claim_terms"] = f"SELECT conv_id, turn, {_claim_duck()} AS value FROM (SELECT conv_id, turn, list_filter({_WORDS}, lambda w: length(w) > 3 AND w NOT IN ({_CLAIM})) AS k FROM conversations)"
