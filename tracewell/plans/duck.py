"""DuckDB SQL for the text expressions, written apart from the Spark ones and used as their oracle."""

from __future__ import annotations

BLANKS = r"[\s\x{00a0}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
QUOTES = "‘’‚‛′`´“”„‟″«»‐‑‒–—―−﹘﹣－"
PLAIN = "''''''''''''''" + '"' * 7 + "-" * 10


def canonical(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, '{QUOTES}', '{PLAIN}'), '{BLANKS}', ' ', 'g'))"


def match_key(x: str) -> str:
    return f"lower({canonical(x)})"


def words(x: str) -> str:
    kept = rf"regexp_replace({match_key(x)}, '[^a-z0-9.\s-]', ' ', 'g')"
    return rf"list_filter(list_transform(string_split_regex({kept}, '\s+'), lambda t: regexp_replace(t, '^[.-]+|[.-]+$', '', 'g')), lambda t: t <> '')"


def grams(w: str, n: int) -> str:
    """All n-grams of a list of words; repeats stay."""
    return f"list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def scorer_text(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(translate(lower({x}), '‘’“”"''`', ''), '[^a-z0-9.\s-]', ' ', 'g'), '\s+', ' ', 'g'))"""


def scorer_words(x: str) -> str:
    return f"list_filter(string_split({scorer_text(x)}, ' '), lambda t: t <> '')"


def unquoted(x: str) -> str:
    return f"""regexp_replace({canonical(x)}, '"[^"]{{20,}}?"', ' ', 'g')"""


def fingerprint(x: str) -> str:
    return f"sha256(trim(regexp_replace({x}, '{BLANKS}', ' ', 'g')))"


def round3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


def list_key(x: str) -> str:
    return f"array_to_string({x}, '|')"


def host(u: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


def query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def canonical_url(u: str) -> str:
    kept = f"array_to_string(list_filter(string_split({query(u)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|fbclid|gclid)')), '&')"
    bare = f"regexp_replace({path(u)}, '/+$', '')"
    return f"lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || {host(u)} || CASE WHEN {bare} = '' THEN '/' ELSE {bare} END || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


def slug(u: str) -> str:
    raw = rf"trim(regexp_replace(lower(array_to_string(string_split({host(u)}, '.')[1:len(string_split({host(u)}, '.')) - 1], '-') || {path(u)}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"ltrim(right({raw}, 80), '-')"


def scheme_less(u: str) -> str:
    return f"lower({host(u)} || regexp_replace({path(u)}, '/+$', '') || CASE WHEN {query(u)} = '' THEN '' ELSE '?' || {query(u)} END)"
