"""Evidence features, candidate pairs, timings and the three scorers, which are kept apart on purpose.

Every function takes and returns DataFrames keyed by ids.  Features are arrays of 64-bit gram hashes; they are columns that are made only
where they are read, and for the documents that are asked for.  Pairs come from equi-joins alone: retrieval and links for the corpus scorer,
and evidence that can decide for the stand-alone one.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import maths, text, urls, walks
from tracewell.operators import grams, retrieval
from tracewell.operators.hold import hold, release

COVERED = 2 / 3
ACCEPTED, PROBABLE, RELATED = 0.35, 0.2, 0.05
#: Similarity alone weighs .3 of itself: below this, rounded, it can neither make a parent (.15) nor come within .05 of one.  It can still be the
#: confidence of a target without a parent.
LEAST_SIMILARITY, JUST_SIMILAR = 0.331, 0.3305


def contained(body: Column, known: DataFrame, key: str) -> Column:
    """the ids, in order, of the known(id, <key>) rows whose key a normalised text contains; any number, in broadcast blocks."""
    blocks = [walks.keys_within(known.sparkSession, block)(body) for block in walks.key_blocks(known.select("id", key))]
    return F.array_sort(F.concat(*blocks)) if blocks else F.array().cast("array<bigint>")


def known_keys(spark: SparkSession, known: DataFrame | Sequence[tuple[int, str]]) -> DataFrame:
    """known(id, text), or a list of such rows, with both normal forms: id, match, scorer.  Of rows with one normal form the least id stands."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "id long, text string")
    rows = rows.select("id", text.match_key(F.col("text")).alias("match"), text.scorer_text(F.col("text")).alias("scorer"))
    first = lambda c: F.when(F.row_number().over(Window.partitionBy(c).orderBy("id")) == 1, F.col(c)).alias(c)
    return rows.select("id", first("match"), first("scorer"))


def artifacts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C19 without arrays: of docs(id, url, text, ...), the row of the least id per content fingerprint, and mirrors(id, url): all URLs of
    each artifact, as rows, so that a page copied a million times is no problem."""
    prints = docs.select("id", "url", text.content_fingerprint(F.col("text")).alias("fingerprint"))
    prints = hold(prints)
    least = prints.groupBy("fingerprint").agg(F.min("id").alias("id"))
    return docs.join(least.select("id"), "id", "left_semi"), prints.select("fingerprint", "url").join(least, "fingerprint").select("id", "url").distinct()


def features(docs: DataFrame, known: DataFrame | Sequence[tuple[int, str]] = ()) -> DataFrame:
    """docs(id, text, url, ts_ms, links, ...) with gram hashes, known errors and keys of both normal forms; citation_variants is empty
    unless docs has it (see walks.matched_citations).  Nothing is computed that is not read: select what you need, and hold() what you
    read more than once."""
    keys = known_keys(docs.sparkSession, known)
    if "citation_variants" not in docs.columns:
        docs = docs.withColumn("citation_variants", F.array().cast("array<string>"))
    return (
        gram_columns(_spread(docs))
        .withColumn("fabricated", contained(F.col("_key"), keys, "match"))
        .withColumn("errors", contained(F.col("_scorer"), keys, "scorer"))
        .drop("_nf", "_key", "_scorer", "_sw")
    )


def gram_columns(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with the normal forms (_nf, _key, _scorer, _sw), the gram hashes of both, and the fingerprint."""
    nf, body = F.col("_nf"), F.col("text")
    return (
        docs.withColumn("_nf", text.nfkc(body))
        .withColumn("_key", text.match_key(nf, False))
        .withColumn("_scorer", text.scorer_text(body))
        .withColumn("g6", text.hashed_grams(text.words(text.unquoted(nf, False), False), 6))
        .withColumn("g3", text.hashed_grams(text.words(nf, False), 3))
        .withColumn("_sw", text.scorer_words(body))
        .withColumn("s6", text.hashed_grams(F.col("_sw"), 6))
        .withColumn("s3", text.hashed_grams(F.col("_sw"), 3))
        .withColumn("words", F.transform("_sw", lambda w: F.xxhash64(w)))
        .withColumn("fingerprint", text.content_fingerprint(nf, False))
    )


def _spread(docs: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores is dealt out once; others are read where they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


NARROW = ["id", "url", "ts_ms", "links", "fabricated", "citation_variants"]


class Corpus:
    """Documents (id, text, url, ts_ms, links), the known errors, and, from one scan, what is known of every document without its text."""

    def __init__(self, docs: DataFrame, known: DataFrame | Sequence[tuple[int, str]] = ()):
        self.docs, self.known, self._timed = docs, known, None
        self.base = hold(features(docs, known).select(*NARROW))

    def members(self) -> DataFrame:
        return self.base.where(included(self.base))

    def timings(self) -> DataFrame:
        """G2 with the lineage's members as anchors, once for all that is scored."""
        if self._timed is None:
            self._timed = hold(timings(self.base, self.members().select("id")))
        return self._timed

    def of_pairs(self, pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The documents that occur in pairs, held: only their texts are read again, and made into those columns."""
        ids = hold(pairs.select(F.col("parent").alias("id")).unionByName(pairs.select(F.col("child").alias("id"))).distinct())
        made = [c for c in columns if c not in NARROW]
        texts = gram_columns(_spread(hold(self.docs.select("id", "text").join(ids, "id", "left_semi"))))
        if "title_key" in columns:
            texts = with_titles(texts)
        return hold(texts.select("id", *made).join(self.base.join(ids, "id", "left_semi"), "id").select("id", "url", "links", *columns))


def included(feats: DataFrame) -> Column:
    """what belongs to the lineage of known errors: a document that repeats one, or a variant of one."""
    return (F.size("fabricated") > 0) | (F.size("citation_variants") > 0)


def retrieved_pairs(corpus: Corpus, most: int = 10) -> DataFrame:
    """(parent, child) of included children: the child's top documents by fused rank, and those that it links to.  Parents outside
    the lineage are among them: they are scored for explanation and never accepted."""
    base, members, docs = corpus.base, corpus.members().select("id"), corpus.docs.select("id", "text")
    cited = base.where(F.size("fabricated") > 0).select("id", F.col("fabricated").alias("citations"))
    queries = retrieval.queries_of(docs.join(members, "id", "left_semi"), cited, corpus.known)
    top = retrieval.related(docs, F.col("text"), queries, cited, most).select(F.col("id").alias("parent"), F.col("query").alias("child"))
    links = base.join(members, "id", "left_semi").select(F.col("id").alias("child"), F.explode("links").alias("url")).join(base.select(F.col("id").alias("parent"), "url"), "url").select("parent", "child")
    return hold(top.unionByName(links).where("parent <> child").distinct())


def url_pairs(urls_of: DataFrame, docs: DataFrame, form) -> DataFrame:
    """(parent, child): the child of docs(id, text, links) links to a URL of urls_of(parent, url) by that form, or has the form in its text."""
    urls_of = urls_of.select("parent", form(F.col("url")).alias("bare")).where("bare <> ''").distinct()
    links = docs.select(F.col("id").alias("child"), F.explode("links").alias("link")).select("child", form(F.col("link")).alias("bare"))
    linked = links.join(urls_of, "bare").select("parent", "child")
    # A URL is found in a text by its tail from the first dot on: of what follows each dot of the text, as far as the longest tail goes, the
    # beginnings that have the length of a tail.  What stands before the dot goes with them and is compared with the URL's head, so no text is exchanged.  A
    # text costs its dots times that length.
    plain = urls_of.where(r"bare RLIKE '^[^\\s.]*\\.\\S*$'").select("parent", F.expr("left(bare, locate('.', bare) - 1)").alias("head"), F.expr("substring(bare, locate('.', bare))").alias("tail"))
    odd = urls_of.where(~F.contains("bare", F.lit(".")))
    sizes = plain.agg(F.collect_set(F.length("tail")).alias("sizes"))  # at most as many as a URL has letters
    longest, widest = (n or 1 for n in plain.agg(F.max(F.length("tail")), F.max(F.length("head"))).first())
    low = docs.select(F.col("id").alias("child"), F.lower("text").alias("body"))
    part = lambda k: F.regexp_extract_all("body", F.lit(rf"(?<![^\s.])([^\s.]*+)\.(?=(\S{{1,{longest}}}))"), k)
    dots = low.select("child", part(1).alias("before"), part(2).alias("after")).where("size(after) > 0")
    dots = dots.select("child", F.expr(f"array_distinct(zip_with(before, after, (b, t) -> struct(right(b, {widest}) AS before, t AS after)))").alias("dots"))
    cut = F.expr("flatten(transform(dots, d -> transform(filter(sizes, n -> n <= length(d.after) + 1), n -> struct(d.before AS before, concat('.', left(d.after, n - 1)) AS tail))))")
    pieces = dots.join(F.broadcast(sizes)).select("child", F.explode(F.array_distinct(cut)).alias("p")).select("child", "p.before", "p.tail")
    found = pieces.join(plain, "tail").where(F.endswith("before", F.col("head"))).select("parent", "child")
    # What has no dot is no host; it counts where it is a whole token.  Only tokens without a dot that have the length of one are exchanged.
    lengths = odd.agg(F.collect_set(F.length("bare"))).first()[0]
    whole = F.filter(F.split("body", r"\s+"), lambda t: F.length(t).isin(lengths) & ~F.contains(t, F.lit(".")))
    tokens = low.select("child", F.explode(F.array_distinct(whole)).alias("bare")) if lengths else low.select("child", F.lit("").alias("bare")).limit(0)
    return linked.unionByName(found).unionByName(tokens.join(odd, "bare").select("parent", "child")).where("parent <> child").distinct()


def rare_phrases(feats: DataFrame) -> DataFrame:
    """(parent, child, rare): 6-grams that, of all documents no later than the child, only the parent shares with it.  Such a gram
    is decided by its three earliest documents, which a grouped limit keeps before the exchange: common phrases cost no pairs."""
    rows = feats.where("ts_ms IS NOT NULL").select("id", "ts_ms", F.explode("g6").alias("gram"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("gram").orderBy("ts_ms", "id"))).where("n <= 3")
    held = first.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "id"))).alias("h")).where("size(h) > 1 AND (size(h) = 2 OR h[2].ts_ms > h[1].ts_ms)")
    both = F.expr("IF(h[0].ts_ms = h[1].ts_ms, array(struct(h[0].id AS parent, h[1].id AS child), struct(h[1].id AS parent, h[0].id AS child)), array(struct(h[0].id AS parent, h[1].id AS child)))")
    pairs = held.select(F.explode(both).alias("p")).groupBy("p.parent", "p.child").agg(F.count(F.lit(1)).alias("rare"))
    # Phrases count from three eligible documents on: those of the fourth time and later have that many.
    fourth = feats.where("ts_ms IS NOT NULL").select("ts_ms").orderBy("ts_ms").limit(4).agg(F.when(F.count(F.lit(1)) == 4, F.max("ts_ms")).alias("fourth"))
    late = feats.select(F.col("id").alias("child"), "ts_ms").join(F.broadcast(fourth)).where("ts_ms >= fourth").select("child")  # one row
    return pairs.join(late, "child", "left_semi")


def similar_pairs(feats: DataFrame, least: float = JUST_SIMILAR) -> DataFrame:
    """(parent, child), the parent no later, of a 3-gram similarity of at least that, of scored_features(); others may be among them: by the rarest grams
    of each, so many that two similar enough sets share one (prefix filtering), then by size.  Of two sets the smaller shares at least half of
    itself in this sense, so it needs fewer grams.  Pairs meet without regard to their order in time, so each once."""
    first = lambda part: F.col("n") - F.ceil(F.col("n") * F.lit(part) - 1e-9) + 1
    alone = F.col("n") - F.size("g3")  # of these grams nobody else has one
    rows = feats.where("ts_ms IS NOT NULL").withColumn("prefix", first(least) - alone).where("prefix > 0")
    rows = rows.select("id", "ts_ms", "n", (first(2 * least / (1 + least))).alias("short"), alone.alias("alone"), F.posexplode(F.slice("g3", F.lit(1), F.col("prefix").cast("int"))).alias("pos", "gram"))
    kept = hold(rows.select("id", "ts_ms", "n", "short", (F.col("alone") + F.col("pos") + 1).alias("place"), "gram"))
    a, b = kept.alias("a"), kept.alias("b")
    able = F.expr(
        f"(a.n < b.n OR a.n = b.n AND a.id < b.id) AND a.place <= a.short AND a.n >= {least} * b.n - 1e-9 AND least(a.n - a.place, b.n - b.place) + 1 >= {least} / (1 + {least}) * (a.n + b.n) - 1e-9"
    )
    pairs = hold(a.join(b, (F.col("a.gram") == F.col("b.gram")) & able).select(F.col("a.id").alias("x"), F.col("a.ts_ms").alias("x_ms"), F.col("b.id").alias("y"), F.col("b.ts_ms").alias("y_ms")).distinct())
    release(kept)
    ways = F.expr("filter(array(IF(x_ms <= y_ms, struct(x AS parent, y AS child), NULL), IF(y_ms <= x_ms, struct(y AS parent, x AS child), NULL)), p -> p IS NOT NULL)")
    return pairs.select(F.inline(ways))


def most_similar(feats: DataFrame, targets: DataFrame) -> DataFrame:
    """(child, similarity): the greatest similarity of each of targets(id) to a document no later, where they share a 3-gram."""
    return grams.most_alike(feats, targets).select("child", maths.round3(F.col("similarity")).alias("similarity"))


def scored_features(feats: DataFrame, *spent: DataFrame) -> DataFrame:
    """What the stand-alone scorer reads of every document several times, held: id, ts_ms, errors, n, g3, g6 (shared_grams()); neither texts nor
    the grams that one document alone has are among it.  spent: held tables that are released as soon as feats has been read."""
    words = hold(feats.select("id", "ts_ms", "errors", "words"))
    release(*spent)
    made = hold(grams.shared_grams(words))
    release(words)
    return made


def candidate_pairs(links: DataFrame, feats: DataFrame) -> DataFrame:
    """(parent, child, link, rare) for the stand-alone scorer, of the url_pairs() and scored_features() of all documents: the parent no later, and a shared known error, a link or the URL in the text, a phrase found in no other earlier document, or a similarity that can
    make a parent.  All other pairs score under .1: they are no parents and make none ambiguous."""
    errors = feats.select("id", F.explode("errors").alias("error"))
    shared = errors.withColumnRenamed("id", "parent").join(errors.withColumnRenamed("id", "child"), "error").where("parent <> child").select("parent", "child")
    no = lambda df: df.select("parent", "child", F.lit(False).alias("link"), F.lit(0).cast("long").alias("rare"))
    linked = links.select("parent", "child", F.lit(True).alias("link"), F.lit(0).cast("long").alias("rare"))
    # Held one by one, so that what is exchanged for one is gone before the next.
    every = [no(shared), no(similar_pairs(feats)), linked, hold(rare_phrases(feats).select("parent", "child", F.lit(False).alias("link"), "rare"))]
    every = functools.reduce(DataFrame.unionByName, every)
    return every.groupBy("parent", "child").agg(F.max("link").alias("link"), F.max("rare").alias("rare"))


def _side(feats: DataFrame, key: str, prefix: str, cols: list[str]) -> DataFrame:
    return feats.select(F.col("id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def similarity(a: str, b: str) -> Column:
    """M2 of T5 over two arrays of distinct hashes."""
    return maths.round3(text.jaccard(F.col(a), F.col(b)))


def timings(docs: DataFrame, anchors: DataFrame | None = None, passes: int = 4) -> DataFrame:
    """Id, claimed, effective, exact, lower, conflict.  A document is no older than what it links to; four passes along links.
    anchors(id): whose dates may bound others, the lineage's members; by default all.  Only documents that link to an anchor change, so
    the passes are over those links."""
    targets = docs if anchors is None else docs.join(anchors.select("id"), "id", "left_semi")
    out = docs.select(F.col("id").alias("child"), F.posexplode("links").alias("pos", "link"))
    links = out.join(targets.select(F.col("id").alias("target"), F.col("url").alias("link")), "link").where("child <> target")
    links = hold(links.groupBy("child", "target").agg(F.min("pos").alias("pos")))
    base = docs.select("id", F.col("ts_ms").alias("claimed"))
    linked = hold(base.join(links.select(F.col("child").alias("id")).distinct(), "id", "left_semi"))
    # What an anchor without links of its own says never changes.
    firm = base.join(links.select(F.col("target").alias("id")).distinct(), "id", "left_semi").join(linked.select("id"), "id", "left_anti").select("id", F.col("claimed").alias("effective"))
    now = linked.select("id", F.col("claimed").alias("effective"))
    for k in range(passes):
        said = links.join(now.unionByName(firm).select(F.col("id").alias("target"), "effective"), "target").where("effective IS NOT NULL")
        # Of the latest targets the first that is linked to gives the reason.
        lower = said.groupBy(F.col("child").alias("id")).agg(F.max(F.struct("effective", (-F.col("pos")).alias("pos"), "target")).alias("by"))
        rows = linked.join(lower, "id", "left")
        later = F.coalesce(F.col("by.effective") > F.col("claimed"), F.col("by").isNotNull())
        rows = rows.withColumn("effective", F.when(later, F.col("by.effective")).otherwise(F.col("claimed")))
        now = rows.select("id", "effective")
    day = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    clash = F.when(F.col("by.effective") > F.col("claimed"), F.concat(F.lit("claims "), day(F.col("claimed")), F.lit(" but links to "), F.col("by.target").cast("string"), F.lit(", published "), day(F.col("by.effective"))))
    bounded = rows.select("id", F.col("effective").alias("e"), F.col("by.effective").alias("lower"), clash.alias("conflict"), F.lit(True).alias("has"))
    effective = F.when(F.col("has"), F.col("e")).otherwise(F.col("claimed"))
    done = base.join(bounded, "id", "left").withColumn("effective", effective)
    return done.select("id", "claimed", "effective", F.coalesce(F.col("effective") == F.col("claimed"), F.lit(False)).alias("exact"), "lower", "conflict")


def ordering(p: str, c: str) -> Column:
    """J6 for columns <p>_links, <p>_url, <p>_claimed, <p>_effective, <p>_exact and the child's."""
    x = lambda side, name: F.col(f"{side}_{name}")
    return (
        F.when(F.array_contains(x(p, "links"), x(c, "url")), "impossible")
        .when(F.array_contains(x(c, "links"), x(p, "url")), "from-link")
        .when(x(c, "exact") & (x(p, "effective") > x(c, "claimed")), "impossible")
        .when(~x(p, "exact") | x(c, "effective").isNull(), "unknown")
        .when(x(c, "exact"), F.when(x(p, "claimed") > x(c, "claimed"), "impossible").when(x(p, "claimed") == x(c, "claimed"), "same-time").otherwise("strict"))
        .when(x(p, "claimed") <= x(c, "effective"), "from-link")
        .otherwise("unknown")
    )


def ordered_pairs(feats: DataFrame, pairs: DataFrame, cols: list[str], timed: DataFrame) -> DataFrame:
    """The pairs with both sides' columns, timings and ordering."""
    own = ["url", "links", "claimed", "effective", "exact", "conflict", *cols]
    rows = feats.join(timed, "id")
    return pairs.join(_side(rows, "parent", "p", own), "parent").join(_side(rows, "child", "c", own), "child").withColumn("ordering", ordering("p", "c"))


# The wording of reasons.
def _reasons(rows: DataFrame, weak: Column) -> Column:
    """C3's reasons, in the order in which they are given."""
    say = lambda when, *parts: F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    c = F.col
    day = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    others = c("carriers") - 1
    also = F.when((c("carriers") > 1) & (c("coverage") >= COVERED), F.concat(F.lit(" (as do "), others.cast("string"), F.lit(" other possible parent"), F.when(others == 1, "").otherwise("s"), F.lit(")"))).otherwise("")
    phrases = F.when(c("unique_phrases") == 1, " copied 6-word phrase").otherwise(" copied 6-word phrases")
    order = c("ordering")
    number = F.regexp_replace(c("similarity").cast("string"), r"\.0$", "")
    return F.array_compact(
        F.array(
            say(c("link"), c("child"), " links to ", c("parent")),
            say(c("shared") > 0, "shares ", c("shared"), " of ", F.size("c_fabricated"), " fabricated citations", also),
            say(c("variants") > 0, "shares the misspelling ", F.array_join(F.transform("variant_names", lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")),
            say(c("unique_phrases") > 0, c("unique_phrases"), phrases, " (outside quotations) found in no other possible parent"),
            say(F.lit(True), "word overlap ", number),
            say(order == "strict", c("parent"), " (", day(c("p_claimed")), ") precedes ", c("child"), " (", day(c("c_effective")), ")"),
            F.when(order == "same-time", F.when(c("link"), "same timestamp; direction taken from the link").otherwise("same timestamp and no link: direction unknown (both may copy an unseen common source)")),
            say((order == "from-link") & ~c("link"), c("child"), " links to a page published on or after ", day(c("c_effective")), ", so it follows ", c("parent")),
            F.when(order == "unknown", F.coalesce(F.concat(F.lit("order unknown: "), c("parent").cast("string"), F.lit(" "), c("p_conflict")), F.lit("order unknown: no trustworthy timestamp"))),
            say(weak & (c("coverage") > 0), "only ", c("shared"), " of ", F.size("c_fabricated"), " fabricated citations shared; a single shared case name is weak evidence"),
            F.when(weak & (c("coverage") == 0), F.when(c("unique_phrases") > 0, "copied phrasing but no link or shared fabricated citation; not enough to claim propagation").otherwise("only textual similarity; not enough to claim propagation")),
        )
    )


def _impossible() -> Column:
    """Why the order of a pair can't be, if it can't."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c, day = F.col, lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    why = (
        F.when(F.array_contains("p_links", c("c_url")), say(c("parent"), " links to ", c("child"), ", so it was written after it"))
        .when(c("p_exact"), say(c("parent"), " (", day(c("p_claimed")), ") was published after ", c("child"), " (", day(c("c_claimed")), ")"))
        .otherwise(say(c("parent"), " links to material from ", day(c("p_effective")), ", after ", c("child"), " (", day(c("c_claimed")), ")"))
    )
    return F.when(c("ordering") == "impossible", why)


def score_edges(corpus: Corpus, pairs: DataFrame, pool: DataFrame | None = None, lineage: bool = True) -> DataFrame:
    """C3 for every (parent, child).  The eligible parents of a child,
    among which evidence is rare, are those of its pairs that are members and may have come first; pool(parent, child): others.
    Parents outside the lineage are scored, marked impossible and never strong; without lineage there is no outside."""
    cols = ["fabricated", "citation_variants", "g6", "g3"]
    asked = pairs if pool is None else pool.unionByName(pairs).distinct()
    wanted = None if pool is None else pairs.withColumn("asked", F.lit(True))
    rows = ordered_pairs(corpus.of_pairs(asked, cols), asked, cols, corpus.timings())
    member = (F.size("p_fabricated") > 0) | (F.size("p_citation_variants") > 0)
    rows = rows.withColumn("member", member if lineage else F.lit(True)).withColumn("why", _impossible())
    rows = rows.withColumn("shared", F.size(F.array_intersect("p_fabricated", "c_fabricated"))).withColumn("variant_names", F.array_intersect("p_citation_variants", "c_citation_variants")).withColumn("variants", F.size("variant_names"))
    # The part of the parent's errors among the child's; carriers cover two thirds of the child's.
    rows = rows.withColumn("coverage", F.when(F.size("c_fabricated") > 0, F.col("shared") / F.size("c_fabricated")).otherwise(0.0))
    eligible = (F.col("ordering") != "impossible") & F.col("member")
    of_child = Window.partitionBy("child")
    rows = rows.withColumn("carriers", F.sum(F.when(eligible & (F.col("coverage") >= COVERED), 1).otherwise(0)).over(of_child))
    rows = rows.withColumn("common", F.array_intersect("p_g6", "c_g6")).withColumn("link", F.array_contains("c_links", F.col("p_url"))).withColumn("similarity", similarity("c_g3", "p_g3"))
    rows = hold(rows.drop("p_g6", "c_g6", "p_g3", "c_g3").withColumn("eligible", eligible))
    # A phrase is a parent's own if no other eligible parent of the child has it.
    grams = rows.where("ordering <> 'impossible'").select("parent", "child", "eligible", F.explode("common").alias("gram"))
    others = F.sum(F.col("eligible").cast("int")).over(Window.partitionBy("child", "gram")) - F.col("eligible").cast("int")
    only = grams.withColumn("others", others).where("others = 0").groupBy("parent", "child").agg(F.count(F.lit(1)).alias("unique_phrases"))
    rows = rows.drop("common").join(only, ["parent", "child"], "left").withColumn("unique_phrases", F.coalesce("unique_phrases", F.lit(0)))
    if wanted is not None:
        rows = rows.join(wanted, ["parent", "child"], "left_semi")
    link, variants = F.col("link"), F.col("variants")
    fabricated = F.when(F.col("coverage") >= COVERED, maths.rarity(F.lit(0.35), F.col("carriers"))).otherwise(F.lit(0.1) * F.col("coverage"))
    confidence = maths.noisy_or(F.when(link, 0.6).otherwise(0.0), fabricated, maths.capped(0.3, F.lit(0.15) * variants), maths.capped(0.3, F.lit(0.05) * F.col("unique_phrases")), maths.capped(0.15, F.col("similarity") * 0.3))
    known = F.col("ordering").isin("strict", "from-link") | link
    tied = link | (F.col("coverage") >= COVERED) | (variants > 0)
    timed = F.when(F.col("ordering") == "same-time", F.least(confidence, F.lit(0.6))).when(F.col("ordering") == "unknown", F.least(confidence, F.lit(0.3))).otherwise(confidence)
    dead = F.col("ordering") == "impossible"
    zero = lambda x: F.when(dead, 0.0).otherwise(x)
    no = lambda x: F.when(dead, False).otherwise(x)
    return rows.select(
        "parent",
        "child",
        "ordering",
        "link",
        maths.round3(F.col("coverage")).alias("coverage"),
        F.col("variants").cast("long").alias("variants"),
        F.when(dead, 0).otherwise(F.col("unique_phrases")).cast("long").alias("unique_phrases"),
        "similarity",
        zero(maths.round3(F.when(tied, timed).otherwise(F.least(timed, F.lit(0.25))))).alias("confidence"),
        zero(maths.round3(timed)).alias("exploratory"),
        (no(known & tied) & F.col("member")).alias("strong"),
        no(link | (F.col("coverage") > 0) | (variants > 0) | (F.col("unique_phrases") > 0)).alias("meaningful"),
        maths.round3((F.col("c_effective") - F.when(F.col("p_exact"), F.col("p_claimed")).otherwise(F.col("p_effective"))) / F.lit(86_400_000.0)).alias("gap_days"),
        F.when(dead, F.array("why")).otherwise(_reasons(rows, ~tied)).alias("reasons"),
        F.coalesce("why", F.when(~F.col("member"), F.concat(F.col("parent").cast("string"), F.lit(" does not repeat any of the fabricated citations")))).alias("impossible"),
    )


def tiers(edges: DataFrame) -> DataFrame:
    """Validated, probable, related or rejected, and the edge's type."""
    tier = (
        F.when(F.col("strong") & (F.col("confidence") >= ACCEPTED), "validated")
        .when(F.col("meaningful") & (F.col("exploratory") >= PROBABLE), "probable")
        .when(F.col("meaningful") & (F.col("exploratory") >= RELATED), "related")
        .otherwise("rejected")
    )
    strong = (F.col("link") | (F.col("coverage") >= maths.round3(F.lit(COVERED)))) & (F.col("confidence") >= 0.5)
    return edges.withColumn("tier", tier).withColumn("type", F.when(strong, "propagation").otherwise("similarity"))


def _compared(pairs: DataFrame, t: DataFrame, c: DataFrame) -> DataFrame:
    """The pairs in the order of time that have any evidence, with similarity and shared known errors."""
    rows = pairs.join(t, "child").join(c, "parent").where("c_ts_ms <= t_ts_ms")
    both = F.size(F.array_intersect("t_g3", "c_g3"))
    alike = F.when((F.col("t_n") == 0) | (F.col("c_n") == 0), 0.0).otherwise(both / (F.col("t_n") + F.col("c_n") - both))
    rows = rows.withColumn("similarity", maths.round3(alike)).withColumn("shared", F.array_intersect("t_errors", "c_errors")).drop("t_g3", "c_g3", "t_n", "c_n", "t_errors", "c_errors")
    return rows.where(f"link OR rare > 0 OR size(shared) > 0 OR similarity >= {LEAST_SIMILARITY}")


def score_candidates(feats: DataFrame, pairs: DataFrame) -> DataFrame:
    """C4, per (child, parent) of candidate_pairs(): the stand-alone scorer."""
    cols = ["ts_ms", "errors", "n", "g3"]
    t, c = _side(feats, "child", "t", cols), _side(feats, "parent", "c", cols)
    pairs = hold(pairs)
    # The child's grams go with each pair; so that they take no more room than those of all documents, pairs are compared in rounds of as many.
    rounds = max(1, -(-pairs.count() // max(1, feats.count())))
    found = [hold(_compared(pairs.where(F.pmod(F.xxhash64("child"), F.lit(rounds)) == k), t, c)) for k in range(rounds)]
    rows = functools.reduce(DataFrame.unionByName, found)
    errors = rows.select("parent", "child", F.explode("shared").alias("error"))
    counts = errors.groupBy("child", "error").agg(F.count(F.lit(1)).alias("n"))
    weights = errors.join(counts, ["child", "error"]).groupBy("parent", "child").agg(F.array_sort(F.collect_list(F.struct("error", "n"))).alias("e")).select("parent", "child", F.least(F.lit(0.7), maths.noisy_or_of(F.transform("e", lambda x: F.lit(0.5) / x["n"]))).alias("errors_weight"), F.size("e").alias("n_errors"))
    rows = rows.join(weights, ["parent", "child"], "left")
    rare_n, error_n = F.col("rare"), F.coalesce("n_errors", F.lit(0))
    confidence = maths.noisy_or(F.when(F.col("link"), 0.6).otherwise(0.0), F.coalesce("errors_weight", F.lit(0.0)), maths.capped(0.25, F.lit(0.04) * rare_n), maths.capped(0.15, F.col("similarity") * 0.3))
    strong = F.col("link") | (error_n > 0)
    weak = F.when(strong, confidence).otherwise(F.least(confidence, F.when(rare_n > 0, 0.4).otherwise(0.25)))
    same = F.when(F.col("c_ts_ms") == F.col("t_ts_ms"), F.least(weak, F.lit(0.6))).otherwise(weak)
    return rows.select("child", "parent", F.col("c_ts_ms").alias("ts_ms"), "link", error_n.cast("long").alias("shared_errors"), rare_n.cast("long").alias("rare_phrases"), "similarity", maths.round3(same).alias("confidence"))


def best_parents(targets: DataFrame, scored: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """C4's answer, one row per target: parent (null under .15), confidence (less if the runner-up is near) and type.  A target without a
    parent has the confidence of its best candidate.  weak: most_similar() of the targets that no evidence brings to .1."""
    order = Window.partitionBy("child").orderBy(F.desc("confidence"), F.desc("ts_ms"), "parent")
    best = scored.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("confidence").over(order)).where("n = 1")
    final = F.when(F.col("confidence") - F.col("next") <= 0.05, maths.round3(F.col("confidence") * 0.6)).otherwise(F.col("confidence"))
    ok = F.coalesce(F.col("confidence") >= 0.15, F.lit(False))
    strong = (F.col("link") | (F.col("shared_errors") > 0)) & (final >= 0.5) & ok
    rows = targets.select(F.col("id").alias("child")).join(best.drop("similarity"), "child", "left")
    rows = rows.withColumn("thin", F.lit(0.0)) if weak is None else rows.join(weak.select("child", maths.round3(maths.noisy_or(maths.capped(0.15, F.col("similarity") * 0.3))).alias("thin")), "child", "left")
    return rows.select(
        "child",
        F.when(ok, F.col("parent")).alias("parent"),
        F.when(ok, final).otherwise(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("thin", F.lit(0.0)))).alias("confidence"),
        F.when(F.coalesce(strong, F.lit(False)), "propagation").otherwise("similarity").alias("type"),
    )


def candidates(docs: DataFrame, known: DataFrame | Sequence[tuple[int, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """scored_features() of docs(id, text, url, ts_ms, links), and score_candidates() of all their candidate_pairs()."""
    docs = hold(docs.select("id", "text", "url", "ts_ms", "links"))  # read for the features and three times for links
    links = hold(url_pairs(docs.select(F.col("id").alias("parent"), "url"), docs, urls.scheme_less_url))
    feats = scored_features(features(docs, known), docs)
    return feats, score_candidates(feats, candidate_pairs(links, feats))


def score_parents(docs: DataFrame, known: DataFrame | Sequence[tuple[int, str]] = ()) -> DataFrame:
    """C4 whole: best_parents() of all docs(id, text, url, ts_ms, links)."""
    feats, scored = candidates(docs, known)
    scored = hold(scored)
    decided = scored.where("confidence >= 0.1").select(F.col("child").alias("id")).distinct()
    return best_parents(feats, scored, most_similar(feats, feats.where("ts_ms IS NOT NULL").select("id").join(decided, "id", "left_anti")))


def to_edges(answers: DataFrame) -> DataFrame:
    """The edges of best_parents()."""
    return answers.where("parent IS NOT NULL").select("parent", "child", "confidence", "type")


def validate(corpus: Corpus, pairs: DataFrame, mirrors: DataFrame | None = None, pool_grams: DataFrame | None = None) -> DataFrame:
    """The inspection of each (parent, child): eight signals, their weights and the verdict.

    mirrors(id, url): all URLs of each document, by default its own.  pairs may have passage (the text that the child is said to have taken:
    C13) and reference_url (where the proposal said that it was: C10).  pool_grams(gram, n): in how many documents of the pool each
    6-gram occurs; by default, the whole table."""
    for column in ("passage", "reference_url"):
        if column not in pairs.columns:
            pairs = pairs.withColumn(column, F.lit(None).cast("string"))
    docs, held = corpus.docs, corpus.base
    mirrors = held.select("id", "url") if mirrors is None else mirrors
    pairs = hold(pairs)  # read for every signal
    cols = ["fabricated", "citation_variants", "g6", "fingerprint", "title_key", "body_key"]
    rows = ordered_pairs(corpus.of_pairs(pairs, cols), pairs, cols, corpus.timings())
    rows = hold(rows.withColumn("common", F.array_intersect("p_g6", "c_g6")).drop("p_g6", "c_g6"))
    grams = rows.select("parent", "child", F.explode("common").alias("gram"))
    if pool_grams is None:
        # Only the grams that pairs share are counted in the pool.
        asked = gram_columns(_spread(docs.select("id", "text"))).select(F.explode("g6").alias("gram")).join(grams.select("gram").distinct(), "gram", "left_semi")
        pool_grams = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    only = grams.join(pool_grams.where("n = 2").select("gram"), "gram", "left_semi").groupBy("parent", "child").agg(F.count(F.lit(1)).alias("phrases"))
    n = F.size("c_fabricated")
    shared, variants = F.size(F.array_intersect("p_fabricated", "c_fabricated")), F.size(F.array_intersect("p_citation_variants", "c_citation_variants"))
    carried = held.select("id", F.explode("fabricated").alias("e"))
    need = rows.select("child", F.explode("c_fabricated").alias("e")).distinct()
    carriers = (
        need.join(carried, "e").where("id <> child").groupBy("child", "id").agg(F.count(F.lit(1)).alias("k"))
        .join(held.select(F.col("id").alias("child"), F.size("fabricated").alias("size")), "child").where(F.col("k") / F.col("size") >= COVERED).groupBy("child").agg(F.count(F.lit(1)).alias("carriers"))
    )
    both = ["parent", "child"]
    asked = pairs.select(F.col("child").alias("id")).distinct()
    their_urls = mirrors.join(pairs.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("parent"), "url")
    linked = url_pairs(their_urls, docs.join(asked, "id", "left_semi"), lambda u: F.lower(urls.bare_url(u))).withColumn("link", F.lit(True))
    named = pairs.where("reference_url IS NOT NULL").select(*both, urls.canonical_url(F.col("reference_url")).alias("u")).join(their_urls.select("parent", urls.canonical_url(F.col("url")).alias("u")), ["parent", "u"], "left_semi").select(*both).distinct().withColumn("resolved", F.lit(True))
    grams5 = lambda c: text.hashed_grams(text.words(F.col(c), False), 5)
    taken = pairs.where("passage IS NOT NULL")
    sources = docs.join(taken.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("parent"), "text")
    parents5 = text.stable(sources, "text").select("parent", grams5("text").alias("p_g5"))
    passages = text.stable(taken.select(*both, "passage"), "passage").select(*both, grams5("passage").alias("g5")).join(parents5, "parent").where("size(g5) > 0").select(*both, maths.round3(F.size(F.array_intersect("g5", "p_g5")) / F.size("g5")).alias("overlap"))
    for more, on in ((only, both), (carriers, ["child"]), (linked, both), (named, both), (passages, both)):
        rows = rows.join(more, on, "left")
    coverage = F.when(n > 0, shared / n).otherwise(0.0)
    discount = F.sqrt(F.greatest(F.lit(1), F.coalesce("carriers", F.lit(0))))
    titled = (F.char_length("p_title_key") >= 12) & (F.size(F.split("p_title_key", " ")) >= 3) & F.contains(F.col("c_body_key"), F.col("p_title_key"))
    set_weight = F.when(coverage >= COVERED, F.lit(0.35) / discount).otherwise(F.lit(0.1) * coverage)
    fabrications = maths.round3(maths.capped(0.7, maths.noisy_or(set_weight, maths.capped(0.3, F.lit(0.15) * variants), maths.capped(0.3, F.lit(0.2) * shared / discount))))
    rows = rows.select(
        "parent",
        "child",
        "ordering",
        (F.col("p_fingerprint") != F.col("c_fingerprint")).alias("distinct_artifact"),
        F.coalesce("link", F.lit(False)).alias("link"),
        titled.alias("titled"),
        F.when(F.col("reference_url").isNull(), "not-applicable").when(F.col("resolved"), "passed").otherwise("failed").alias("canonical_metadata"),
        F.when((shared > 0) | (variants > 0), fabrications).otherwise(0.0).alias("fabrications"),
        F.coalesce("phrases", F.lit(0)).alias("phrases"),
        "overlap",
    )
    out_of = (~F.col("distinct_artifact")) | (F.col("ordering") == "impossible") | (F.col("canonical_metadata") == "failed")
    phrasing = maths.round3(maths.capped(0.3, F.lit(0.05) * F.col("phrases")))
    covered = F.coalesce(F.col("overlap") >= 0.5, F.lit(False))
    passage = F.when(covered, maths.round3(maths.capped(0.2, F.lit(0.25) * F.col("overlap")))).otherwise(0.0)
    raw = maths.noisy_or(F.when(F.col("link"), 0.6).otherwise(0.0), F.when(F.col("titled"), 0.45).otherwise(0.0), F.col("fabrications"), phrasing, passage)
    strong = F.col("link") | F.col("titled") | (F.col("fabrications") > 0)
    directed = F.col("ordering").isin("strict", "from-link") | F.col("link")
    capped = F.when(strong, raw).otherwise(F.least(raw, F.lit(0.25)))
    capped = F.when(F.col("ordering") == "unknown", F.least(capped, F.lit(0.3))).when(F.col("ordering") == "same-time", F.least(capped, F.lit(0.6))).otherwise(capped)
    none = ~strong & (F.col("phrases") == 0) & ~covered
    relation = (
        F.when(out_of, "contradicted").when(none, "unsupported").when(strong & directed & (capped >= ACCEPTED), "propagation").when(strong & ~directed, "shared-source").otherwise("similarity")
    )
    return (
        rows.withColumn("relationship", relation)
        .withColumn("confidence", F.when(out_of | none, 0.0).otherwise(maths.round3(capped)))
        .withColumn("accepted", (F.col("relationship") == "propagation") & (F.col("confidence") >= ACCEPTED))
    )


def with_titles(feats: DataFrame) -> DataFrame:
    """What C6 to C14 also read: the text's key, and its first line as title."""
    title = text.match_key(F.regexp_extract("text", r"^[^\n]*", 0))
    return feats.withColumn("body_key", text.match_key(F.col("text"))).withColumn("title_key", title)
