"""Text expressions.  All but ``nfkc`` and the walks in ``walks.py`` stay in the JVM.

compat: apply NFKC first, a Python step for the texts that it may change; callers that need several forms of a text apply ``nfkc`` once and pass False."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as quotes, dashes and white space.
SINGLE_QUOTES = "‘’‚‛′`´"
DOUBLE_QUOTES = "“”„‟″«»"
DASHES = "‐‑‒–—―−﹘﹣－"
BLANKS = r"[\s  -​    　﻿]+"
QUOTES_DROPPED = "‘’“”\"'`"
# Stop words of claim terms.
CLAIM_STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the their this to was were which with were real decisions decision case cases court"
).split()
# Words without search value.
GENERIC_WORDS = (
    "a about after all also an and any are as at be because been before between both but by can could did do does during each for from had has have how "
    "however i if in including into is it its just many may more most much no not of on one only or other our over she should so some such than that the their "
    "them then there these they this those three to too two four five very was we were what when where which who whom why will with would you your "
    "says said say relies relied motion decision decisions case cases court similar circumstances according granted several various first new"
).split()


#: What NFKC may change: all but these characters, each of which stands for itself and combines with none of them.
UNSTABLE = (
    r"[^\x{0}-\x{9f}\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2030}-\x{2032}\x{2039}\x{203a}\x{20ac}]"
)

#: The same for Java, which tries the parts of a class one by one: ASCII is passed at once.
_ODD = rf"[[^\x00-\x7f]&&{UNSTABLE}]"


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode NFKC, which Spark has no function for.  Only texts that it may change go to Python."""
    return F.coalesce(_folded(F.when(c.rlike(_ODD), c)), c)


def stable(df: DataFrame, column: str) -> DataFrame:
    """df with the column in NFKC, as a step of its own: expressions behind it (lambdas, generators) are never merged with Python's part."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = pc.fill_null(pc.match_substring_regex(b.column(at), UNSTABLE), False)
            if pc.any(odd).as_py():
                kept = b.column(at)
                texts = pa.array([unicodedata.normalize("NFKC", x) for x in kept.filter(odd).to_pylist()], kept.type)
                b = b.set_column(at, b.schema.field(at), pc.replace_with_mask(kept, odd, texts))
            yield b

    return df.mapInArrow(run, df.schema)


def canonical_text(c: Column, compat: bool = True) -> Column:
    """T1.  compat: apply NFKC (a Python step); without it the text must be NFKC-stable."""
    c = nfkc(c) if compat else c
    swapped = F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    return F.trim(F.regexp_replace(swapped, BLANKS, " "))


def match_key(c: Column, compat: bool = True) -> Column:
    """T2."""
    return F.lower(canonical_text(c, compat))


def words(c: Column, compat: bool = True) -> Column:
    """ASCII words, numbers, dots and dashes, without dots and dashes at a word's ends."""
    c = F.lower(F.translate(nfkc(c) if compat else c, DASHES, "-" * len(DASHES)))
    return F.regexp_extract_all(c, F.lit(r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?"), F.lit(0))


def shingles(w: Column, n: int) -> Column:
    """T4: the distinct word n-grams of an array of words."""
    def grams(v: Column) -> Column:
        last = F.size(v) - (n - 1)
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(v, i, n), " "))
        return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    # Binding the words to a variable keeps their expression out of the inner lambda, where it would run once per gram.
    return F.get(F.transform(F.array(w), grams), F.lit(0))


def hashed_grams(w: Column, n: int) -> Column:
    """T4 as 64-bit hashes: the distinct word n-grams of an array of words, without building their strings."""
    def grams(h: Column) -> Column:
        last = F.size(h) - (n - 1)
        every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), grams), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """T5, of arrays without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def case_key(c: Column, compat: bool = True) -> Column:
    """T7."""
    return F.regexp_replace(match_key(c, compat), r"\s*-\s*", "-")


def levenshtein(a: Column, b: Column) -> Column:
    """T8."""
    return F.levenshtein(a, b)


def unquoted(c: Column, compat: bool = True) -> Column:
    """Quotations of 20 characters and more become a space."""
    return F.regexp_replace(canonical_text(c, compat), r'"[^"]{20,}?"', " ")


def fingerprint_text(c: Column, compat: bool = True) -> Column:
    """T11."""
    return F.trim(F.regexp_replace(nfkc(c) if compat else c, BLANKS, " "))


def content_fingerprint(c: Column, compat: bool = True) -> Column:
    """T12."""
    return F.sha2(fingerprint_text(c, compat).cast("binary"), 256)


def canonical_document_id(fingerprint: Column) -> Column:
    return F.concat(F.lit("sha256:"), fingerprint)


# A sentence ends at these signs before what a sentence begins with, but not behind these abbreviations.
SENTENCE_END = r"(?<=[.!?])(?<!\b[vV]\.)(?<!\b(?:Mr|Mrs|Ms|Dr|Prof|No)\.)\s+(?=[\"'(\[A-Z0-9])"


def sentences(c: Column, compat: bool = True) -> Column:
    """The sentences of four words and more."""
    parts = F.split(canonical_text(c) if compat else c, SENTENCE_END)
    return F.coalesce(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: F.size(words(s, False)) >= 4), F.array().cast("array<string>"))


def unit_key(c: Column, compat: bool = True) -> Column:
    """The key under which two claim sentences count as equal."""
    return F.trim(F.regexp_replace(F.regexp_replace(match_key(c, compat), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def quote(c: Column, most: int = 240) -> Column:
    """T16."""
    short = F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))
    return F.concat(F.lit("“"), F.when(F.char_length(c) <= most, c).otherwise(short), F.lit("”"))


def plain_text(c: Column) -> Column:
    """Lower case, quotes dropped, white space squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), QUOTES_DROPPED, ""), r"\s+", " "))


def scorer_text(c: Column) -> Column:
    """The stand-alone scorer's normal form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), QUOTES_DROPPED, ""), r"[^a-z0-9.\s-]", " "), r"\s+", " "))


def scorer_words(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(c), QUOTES_DROPPED, ""), F.lit(r"[a-z0-9.-]+"), F.lit(0))


def unicode_words(c: Column) -> Column:
    """T23."""
    return F.filter(F.split(F.regexp_replace(match_key(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def is_content_word(w: Column) -> Column:
    return (F.char_length(w) >= 3) & ~w.isin(*GENERIC_WORDS) & ~w.rlike(r"[0-9]")


def informative(c: Column) -> Column:
    """T27."""
    return (F.size(F.filter(unicode_words(F.translate(c, '"', " ")), is_content_word)) >= 2) | c.rlike(r"[0-9]")


def claim_terms(c: Column, citations: tuple[str, ...] = ()) -> Column:
    """The first eight distinct telling words of a claim; each citation's first occurrence is left out."""
    rest = canonical_text(c)
    for citation in citations:
        at = F.locate(citation, rest)
        rest = F.when(at > 0, F.concat(F.substring(rest, F.lit(1), at - 1), F.lit(" "), F.substring(rest, at + F.lit(len(citation)), F.char_length(rest)))).otherwise(rest)
    return F.slice(F.array_distinct(F.filter(words(rest, False), lambda w: (F.char_length(w) > 3) & ~w.isin(*CLAIM_STOPWORDS))), 1, 8)


def fit_query(c: Column, most: int = 200) -> Column:
    """Cut at a word's end; a query in quotes stays in quotes."""
    quoted = c.startswith('"') & c.endswith('"')
    inner = F.when(quoted, F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)
    head = F.substring(inner, F.lit(1), F.when(quoted, most - 2).otherwise(most) + 1)
    space = F.char_length(head) - F.locate(" ", F.reverse(head))
    cut = F.trim(F.substring(head, F.lit(1), F.greatest(F.when(F.locate(" ", head) == 0, 1).otherwise(space), F.lit(1))))
    return F.when(F.char_length(c) <= most, c).when(quoted, F.concat(F.lit('"'), cut, F.lit('"'))).otherwise(cut)


def title_key(c: Column) -> Column:
    """T36."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def proposal_label(*c: Column) -> Column:
    """T38."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(x), F.lit("")) for x in c])


def strip_tail(c: Column) -> Column:
    """T39."""
    return F.regexp_replace(c, r"[.,;:)\]]+$", "")


# Patterns of correction routes with their weights, and of links that are none.
ROUTES = [
    (r"(?i)\bcorrections?\b|\bcorrect(ing)?\b", 5),
    (r"(?i)report (an? )?(error|mistake|inaccuracy)", 6),
    (r"(?i)\berrat(a|um)\b", 5),
    (r"(?i)\b(error|mistake|inaccura\w*)\b", 3),
    (r"(?i)\bfact.?check\b", 2),
    (r"(?i)\bcontact (the )?(editors?|newsroom)\b", 3),
    (r"(?i)\bfeedback\b", 1),
]
NO_ROUTE = r"(?i)\b(subscribe|subscription|advertis\w*|newsletter|sign ?in|log ?in|donate|careers?|privacy|cookie|terms)\b"
# Form fields in the order in which rules apply.
FIELDS = [
    ("passage", r"(?i)\b(passage|quot(e|ed|ation)|excerpt|original text|text in question)\b"),
    ("email", r"(?i)\be-?mail\b|\bcontact (address|email)\b"),
    ("sources", r"(?i)\b(sources?|evidence|links?|urls?|references?|citations?)\b"),
    ("subject", r"(?i)\b(subject|headline|title|summary)\b"),
    ("name", r"(?i)\b(name)\b"),
    ("body", r"(?i)\b(details?|explanation|explain|message|description|comments?|correction|what is wrong|should say|body)\b"),
]


def route_score(c: Column) -> Column:
    """T20."""
    total = F.lit(0)
    for pattern, weight in ROUTES:
        total = total + F.when(c.rlike(pattern), weight).otherwise(0)
    return F.when(c.rlike(NO_ROUTE), 0).otherwise(total)


def classify_field(descriptor: Column, input_type: Column) -> Column:
    """T21."""
    out = F.when(input_type == "email", "email")
    for slot, pattern in FIELDS:
        out = out.when(descriptor.rlike(pattern), slot)
    return out


def choose_passage(text: Column, citations: Column, terms: Column) -> Column:
    """The paragraph with most citations (ten points each) and claim terms; the first one, if none has any.  Texts are NFKC-stable
    here (see nfkc): Python steps can't run inside a lambda."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(p)), lambda p: p != "")

    def points(p: Column) -> Column:
        key = match_key(p, False)
        found = lambda many: F.size(F.filter(many, lambda x: F.contains(key, match_key(x, False))))
        return found(citations) * 10 + found(terms)

    scored = F.transform(paragraphs, lambda p, i: F.struct((-points(p)).alias("s"), i.alias("i"), p.alias("p")))
    return F.coalesce(F.get(F.array_sort(scored), F.lit(0))["p"], F.lit(""))


def passage_preview(text: Column, most: int = 720) -> Column:
    """At most four sentences and 720 characters."""
    head = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.!?])\s+"), 1, 4), " ")
    return F.when(F.char_length(head) > most, F.concat(F.rtrim(F.substring(head, 1, most - 1)), F.lit("…"))).otherwise(head)


def display_title(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), url)
