"""Queries of search planning over whole texts, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import planning, scoring
from tracewell.plans import duck
from tracewell.plans.adapters import known_errors
from tracewell.plans.scoring import KNOWN_SQL


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def t24_topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.topic_words(_texts(spark, sf_dir)).select("id", F.array_join("topic", " ").alias("topic"))


def t26_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.distinctive_fragment(_texts(spark, sf_dir))


def t31_phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each known error the phrases to search for, and where they are found."""
    docs = _texts(spark, sf_dir)
    keys = scoring.known_keys(spark, known_errors(spark, sf_dir))
    return planning.phrase_hits(docs, planning.phrase_queries(planning.fingerprint_sentences(docs, keys)))


QUERIES = {f.__name__: f for f in (t24_topic_words, t26_fragment, t31_phrase_hits)}
_GENERIC = ", ".join(f"'{w}'" for w in text.GENERIC_WORDS)
ORACLES = {
    "t24_topic_words": rf"""WITH w AS (SELECT doc_id AS id, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, string_split_regex(text, '{duck.BLANKS}') AS ws FROM documents)),
      b AS (SELECT *, regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}-]+', '', 'g') AS word, regexp_matches(raw, '[,;:.!?)]$') AS closes FROM w),
      c AS (SELECT *, length(word) >= 3 AND word NOT IN ({_GENERIC}) AND NOT regexp_matches(word, '[0-9]') AS content FROM b),
      g AS (SELECT *, coalesce(lag(content) OVER o AND NOT lag(closes) OVER o, false) AS on_ FROM c WINDOW o AS (PARTITION BY id ORDER BY pos)),
      i AS (SELECT *, sum(CASE WHEN content AND NOT on_ THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM g),
      r AS (SELECT id, run, sum(length(word)) AS size, list(word ORDER BY pos) AS ws FROM i WHERE content GROUP BY id, run),
      k AS (SELECT id, run, ws FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY size DESC, run) <= 2)
      SELECT doc_id AS id, coalesce(t, '') AS topic FROM documents LEFT JOIN (SELECT id, array_to_string(flatten(list(ws ORDER BY run))[1:4], ' ') AS t FROM k GROUP BY id) ON id = doc_id""",
    "t26_fragment": rf"""WITH s AS (SELECT doc_id AS id, unnest(ss) AS seg, generate_subscripts(ss, 1) AS k FROM (SELECT doc_id, string_split(text, '¦') AS ss FROM documents)),
      q AS MATERIALIZED (SELECT id, k, list_filter(string_split_regex(seg, '{duck.BLANKS}'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS ws FROM s),
      w AS (SELECT id, k, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM q WHERE len(ws) >= 5),
      b AS (SELECT *, regexp_replace(lower(word), '[^\p{{L}}\p{{N}}]+', '', 'g') AS bare FROM w), t AS (SELECT *, bare <> '' AND bare NOT IN ({_GENERIC}) AS told FROM b),
      p AS (SELECT *, CASE WHEN told THEN 24 + 3 * least(length(bare), 12) + CASE WHEN regexp_matches(bare, '[0-9]') THEN 30 ELSE 0 END ELSE 0 END AS sc, CASE WHEN told AND regexp_matches(word, '^\p{{Lu}}') THEN 18 ELSE 0 END AS cap FROM t),
      f AS (SELECT id, k, i, n, sum(sc + cap) OVER o - cap AS score, sum(told::INT) OVER o AS told FROM p WINDOW o AS (PARTITION BY id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
      x AS (SELECT id, k, i FROM f WHERE told >= 3 AND i <= greatest(n - 7, 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, k, i) = 1),
      y AS (SELECT id, nullif(replace(regexp_replace(array_to_string(ws[i:i + 7], ' '), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), chr(34), ''), '') AS fragment FROM x JOIN q USING (id, k))
      SELECT doc_id AS id, fragment FROM documents LEFT JOIN y ON y.id = doc_id""",
    "t31_phrase_hits": rf"""WITH {KNOWN_SQL}, d AS MATERIALIZED (SELECT doc_id AS id, {duck.match_key('text')} AS key, string_split(text, chr(10)) AS ps FROM documents),
      p AS MATERIALIZED (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM d), h AS (SELECT p.id, p.i, item_id AS run FROM (SELECT id, i, {duck.match_key('p')} AS k FROM p) p JOIN known ON contains(p.k, known.k)),
      nr AS (SELECT DISTINCT id, run, i + j AS i FROM h, (VALUES (-1), (0), (1)) v(j)), a AS (SELECT nr.run, nr.id, string_agg(p.p, ' ' ORDER BY p.i) AS t FROM nr JOIN p ON p.id = nr.id AND p.i = nr.i GROUP BY nr.run, nr.id),
      s AS (SELECT run, id, regexp_replace(trim(unnest(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), '[.!?]+$', '') AS s FROM a),
      k AS (SELECT DISTINCT run, id, {duck.match_key('s')} AS phrase FROM s WHERE len(string_split(s, ' ')) >= 8 AND NOT contains(s, chr(34)) AND NOT contains(s, ' v. ')),
      c AS (SELECT run, phrase, count(*) AS df FROM k GROUP BY run, phrase), q AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY df, length(phrase) DESC, phrase) AS n FROM c QUALIFY n <= 3)
      SELECT run, n, phrase, df, d.id FROM q JOIN d ON contains(d.key, q.phrase)""",
}
