"""Queries of retrieval, graph, proposal and walk operators, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text, urls, walks
from tracewell.operators import changes, lineage, proposals, retrieval, scoring
from tracewell.operators.hold import hold
from tracewell.plans import duck
from tracewell.plans.adapters import CORPUS_SQL, corpus, known_errors
from tracewell.plans.scoring import HELD_SQL, KNOWN_SQL, asked_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus, and the stated query set: the passage (T40, without citations) of every document whose id is divisible by 20."""
    docs = corpus(spark, sf_dir).select("id", "text")
    nobody = docs.select("id", F.array().cast("array<bigint>").alias("citations"))
    return docs, retrieval.queries_of(docs.where("id % 20 = 0"), nobody, known_errors(spark, sf_dir))


def a04_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.mirrors(corpus(spark, sf_dir)).withColumn("mirror_urls", F.array_join("mirror_urls", "|"))


def c20_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = _passages(spark, sf_dir)
    return retrieval.bm25(docs, F.col("text"), queries, 10)


def c21_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of passages and citations, fused with the documents that share a known error with the query."""
    docs = corpus(spark, sf_dir).select("id", "text")
    known = known_errors(spark, sf_dir)
    cited = docs.select("id", scoring.contained(text.match_key(F.col("text")), scoring.known_keys(spark, known), "match").alias("citations"))
    asked = docs.where("id % 20 = 0")
    return retrieval.related(docs, F.col("text"), retrieval.queries_of(asked, cited.join(asked, "id", "left_semi"), known), cited)


def c22_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.cosine_top(vectors, vectors.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q")), 10)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph with long chains over all documents: each is a child of the one with a third of its id."""
    nodes = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return nodes, nodes.where("id > 0").select(F.expr("id div 3").alias("parent"), F.col("id").alias("child"))


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus(spark, sf_dir)
    links = docs.select(F.col("id").alias("child"), F.explode("links").alias("url"))
    return docs.select("id"), links.join(docs.select("url", F.col("id").alias("parent")), "url").select("parent", "child")


def g03_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tree(spark, sf_dir)
    return lineage.reachable(nodes.where("id = 1"), edges.select(F.col("parent").alias("source"), F.col("child").alias("target")), 2)


def g05_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.ancestry(_tree(spark, sf_dir)[1])


def g06_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tree(spark, sf_dir)
    closing = nodes.where("id % 3 = 1 AND id > 3").select(F.col("id").alias("parent"), F.expr("id div 3").alias("child"))
    return lineage.cycle_edges(edges.unionByName(closing))


def g07_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.roots(*_copies(spark, sf_dir))


def g08_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.structural_depths(*_tree(spark, sf_dir))


def g09_primary_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").where("doc_id > 3")
    options = rows.select(F.col("doc_id").alias("child"), "n_chars", F.explode(F.array(F.expr("doc_id div 2"), F.expr("doc_id div 3"))).alias("parent"))
    return lineage.primary_parents(options.select("parent", "child", (F.col("parent") % 2).alias("status_rank"), (F.col("parent") % 7 / 7).alias("confidence"), F.col("parent").alias("ts_ms")))


def g11_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.components(*_copies(spark, sf_dir))


def a13_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return proposals.merge_hits(pages.select("url", (F.col("page_id") % 7).alias("query"), (F.col("page_id") % 5).alias("rank")))


def a14_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    gap = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), F.col("page_id")))
    rows = pages.select(F.col("page_id").alias("place"), urls.host(F.col("url")).alias("host"), gap.alias("title"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("citation"), F.concat(F.lit("c"), F.col("page_id") % 3).alias("channel"))
    merged = proposals.merge(rows.withColumn("url", F.concat(F.lit("https://"), F.col("host"), F.lit("/"))).drop("host"))
    return merged.select("key", "place", "url", "title", F.array_join("channels", "|").alias("channels"))


def c24_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    docs = pages.select(F.col("page_id").alias("id"), F.concat(F.lit("see "), F.col("url"), F.lit(". arXiv:2401.0"), 1000 + F.col("page_id") % 9000, F.lit(" and 10.1234/x."), F.col("page_id"), F.lit("."), F.lit(" No. 21-1234")).alias("text"), F.array("url").alias("links"))
    return proposals.native(docs)


def w07_earlier_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's role before it, and whether the user spoke earlier."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.coalesce(F.max((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("user_before"))


def a16_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A18 per source: documents, links, cross-links and whether any document has a link."""
    nodes, edges = _copies(spark, sf_dir)
    indeg = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"))
    docs = corpus(spark, sf_dir).select("id", "source").join(indeg, F.col("child") == F.col("id"), "left")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("crosslinks"), F.coalesce(F.bool_or(F.col("n") > 0), F.lit(False)).alias("any_link"))


def c16_build_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per known error: its carriers, scored and assembled.  Order matters, so SQL has no twin; see the tests."""
    docs, _ = scoring.artifacts(corpus(spark, sf_dir))
    docs = scoring.Corpus(docs, known_errors(spark, sf_dir))
    edges = hold(scoring.score_edges(docs, scoring.retrieved_pairs(docs)))
    member = docs.base.select("id", F.explode("fabricated").alias("run"))
    times = docs.timings().select(F.col("id").alias("child"), F.col("effective").alias("child_ms"))
    rows = edges.join(member.select(F.col("id").alias("child"), "run"), "child").join(member.select(F.col("id").alias("parent"), "run"), ["parent", "run"]).join(times, "child")
    return lineage.build_trees(rows.select("run", "parent", "child", "confidence", "strong", (F.col("ordering") == "impossible").alias("impossible"), "link", "child_ms"))


def c18_claim_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each turn's claims differ from those of the turn before."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("parent"))
    return changes.claim_changes(turns.join(before, ["conv_id", "turn"]).withColumnRenamed("text", "child"), ["conv_id", "turn"])


def t06_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, T9 on benchmark items, each set in a sentence with a case name made from its id."""
    body = F.concat(F.lit("See Abel v. Cain-"), F.col("item_id").cast("string"), F.lit(", and In Roe v. Smith. "), F.col("text"))
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(walks.case_names_of(body), "|").alias("value"))


def t13_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.sentences(F.col("text")), "|").alias("value"))


def t17_common_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("parent"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", walks.common_substring_of("parent", "text").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        a04_mirrors, a13_hits, a14_merge, a16_run_stats, c16_build_tree, c18_claim_changes, c20_bm25, c21_rrf, c22_cosine, c24_native,
        g03_reachable, g05_ancestry, g06_cycles, g07_roots, g08_depths, g09_primary_parents, g11_components, t06_case_names, t13_sentences, t17_common_substring, w07_earlier_turns,
    )
}

_ASKED = asked_sql("id % 20 = 0")
#: No citations, and those of the known errors.
_BARE = "known AS (SELECT item_id, text FROM benchmark), f AS (SELECT doc_id AS id, text, []::BIGINT[] AS fab FROM documents)"
_KNOWING = f"{KNOWN_SQL}, w AS MATERIALIZED (SELECT doc_id AS id, text, {duck.match_key('text')} AS k, {duck.scorer_text('text')} AS sk FROM documents), f AS MATERIALIZED (SELECT id, text, {HELD_SQL} FROM w)"
_BM25 = f"""ws AS MATERIALIZED (SELECT doc_id AS id, {duck.words('text')} AS w FROM documents), p AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM ws) GROUP BY id, term),
  st AS (SELECT count(*) AS total, avg(len(w)) AS av FROM ws), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  q AS (SELECT DISTINCT query, unnest(words) AS term FROM qs),
  sc AS (SELECT query, id, round(sum(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / av))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st WHERE id <> query GROUP BY query, id),
  bm AS (SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10)"""
_TREE = "e AS (SELECT doc_id // 3 AS parent, doc_id AS child FROM documents WHERE doc_id > 0)"
_LINKS = "lk AS (SELECT p.id AS parent, c.id AS child FROM (SELECT id, unnest(links) AS l FROM corpus) c JOIN corpus p ON p.url = c.l)"
_REACH = "r AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT r.node, e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.ancestor WHERE r.depth < 60)"

ORACLES = {
    "a04_mirrors": f"WITH {CORPUS_SQL}, g AS (SELECT fp AS fingerprint, list_sort(list(DISTINCT url)) AS urls FROM (SELECT url, {duck.fingerprint('text')} AS fp FROM corpus) GROUP BY fp), s AS (SELECT fingerprint, urls[1] AS url, array_to_string(urls[2:], '|') AS mirror_urls, {duck.slug('urls[1]')} AS slug FROM g) SELECT CASE WHEN count(*) OVER (PARTITION BY slug) = 1 THEN slug ELSE slug || '-' || fingerprint END AS id, fingerprint, url, mirror_urls FROM s",
    "a13_hits": f"SELECT {duck.canonical_url('url')} AS url, min(page_id % 5) AS best_rank, count(DISTINCT page_id % 7) AS n_queries FROM pages GROUP BY 1",
    "a14_merge": f"SELECT 'url:https://' || h || '/' AS key, min(page_id) AS place, 'https://' || h || '/' AS url, CASE WHEN min(page_id) FILTER (page_id % 2 = 0) IS NOT NULL THEN 't' || min(page_id) FILTER (page_id % 2 = 0) END AS title, array_to_string(list_sort(list(DISTINCT 'c' || page_id % 3)), '|') AS channels FROM (SELECT page_id, {duck.host('url')} AS h FROM pages) GROUP BY h",
    "a16_run_stats": f"WITH {CORPUS_SQL}, {_LINKS}, n AS (SELECT child, count(*) AS n FROM lk GROUP BY child) SELECT source, count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_links, coalesce(sum(greatest(n - 1, 0)), 0)::BIGINT AS crosslinks, coalesce(bool_or(n > 0), false) AS any_link FROM corpus LEFT JOIN n ON n.child = id GROUP BY source",
    "c20_bm25": f"WITH {_BARE}, {_ASKED}, {_BM25} SELECT query, id, score, rank FROM bm",
    "c21_rrf": f"""WITH {_KNOWING}, {_ASKED}, {_BM25}, k AS MATERIALIZED (SELECT id, unnest(fab) AS item_id FROM f),
      sh AS (SELECT x.id AS query, y.id, count(*) AS n FROM k x JOIN k y USING (item_id) WHERE x.id <> y.id GROUP BY 1, 2), sr AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY n DESC, id) AS rank FROM sh),
      fu AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, id, rank FROM bm UNION ALL SELECT query, id, rank FROM sr WHERE query % 20 = 0) GROUP BY query, id)
      SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= 10""",
    "c22_cosine": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.id AS query, v.id, round(list_sum(list_transform(list_zip(v.v, q.v), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(v.v, lambda x: x * x))) / sqrt(list_sum(list_transform(q.v, lambda x: x * x))), 6) AS score FROM v JOIN v q ON q.id <> v.id WHERE q.id % 20 = 0)
      SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "c24_native": f"""WITH b AS (SELECT page_id AS id, url, 'arXiv:2401.0' || (1000 + page_id % 9000) AS ax FROM pages),
      a AS (SELECT id, 1 AS n, 'url:' || {duck.canonical_url('url')} AS key, url, NULL AS citation, 'outbound_link' AS signal FROM b UNION ALL SELECT id, 2, 'doi:10.1234/x.' || id, 'https://doi.org/10.1234/x.' || id, '10.1234/x.' || id, 'doi' FROM b
        UNION ALL SELECT id, 3, 'arxiv:' || ax[7:], 'https://arxiv.org/abs/' || ax[7:], ax, 'arxiv' FROM b UNION ALL SELECT id, 4, 'docket:no. 21-1234', NULL, 'No. 21-1234', 'named_source' FROM b) SELECT * FROM a""",
    "g03_reachable": f"WITH {_TREE} SELECT 1 AS id, 0 AS depth UNION ALL SELECT child, 1 FROM e WHERE parent = 1 UNION ALL SELECT y.child, 2 FROM e x JOIN e y ON y.parent = x.child WHERE x.parent = 1",
    "g05_ancestry": f"WITH RECURSIVE {_TREE}, {_REACH} SELECT node, ancestor, min(depth) AS depth FROM r WHERE node <> ancestor GROUP BY node, ancestor",
    "g06_cycles": f"WITH RECURSIVE {_TREE} SELECT parent, child FROM e WHERE child % 3 = 1 AND child > 3 UNION SELECT child, parent FROM e WHERE child % 3 = 1 AND child > 3",
    "g07_roots": f"WITH {CORPUS_SQL}, {_LINKS} SELECT id FROM corpus WHERE id NOT IN (SELECT child FROM lk)",
    "g08_depths": f"WITH RECURSIVE {_TREE}, {_REACH} SELECT doc_id AS id, coalesce(max(depth), 0) AS depth FROM documents LEFT JOIN r ON node = doc_id GROUP BY doc_id",
    "g09_primary_parents": "WITH o AS (SELECT doc_id AS child, unnest([doc_id // 2, doc_id // 3]) AS parent FROM documents WHERE doc_id > 3) SELECT child, parent FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY parent % 2, parent % 7 / 7.0 DESC, parent) AS n FROM o) WHERE n = 1",
    "g11_components": f"WITH RECURSIVE {CORPUS_SQL}, {_LINKS}, up AS (SELECT id, id AS top FROM corpus UNION ALL SELECT up.id, lk.parent FROM up JOIN lk ON lk.child = up.top), m AS (SELECT id, min(top) AS component FROM up GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM m",
    "t06_case_names": "SELECT item_id, 'Abel v. Cain-' || item_id || '|Roe v. Smith' AS value FROM benchmark",
    # A mark ends each sentence and is taken back behind abbreviations.
    "t13_sentences": rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace({duck.canonical('text')}, '([.!?])\s+([\x22\x27(\[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '(\b[vV]\.|\b(?:Mr|Mrs|Ms|Dr|Prof|No)\.)' || chr(1), '\1 ', 'g') AS s FROM documents),
      p AS (SELECT doc_id, list_filter(list_transform(string_split(s, chr(1)), lambda x: trim(x)), lambda x: len({duck.words('x')}) >= 4) AS parts FROM m) SELECT doc_id, array_to_string(parts, '|') AS value FROM p""",
    "w07_earlier_turns": "SELECT conv_id, turn, lag(role) OVER w AS before, coalesce(max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS user_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
}
