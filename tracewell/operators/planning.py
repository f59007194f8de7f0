"""What to search for: topic words, the most distinctive fragment, and sentences whose copies neither cite nor link.

Topic runs are found by a fold over a text's words; a fragment is the best of sliding sums within its row; sentences are rows, counted per run, and all of
them are looked up in all texts in one pass over these.  Null and empty texts have none of them; ties go to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text, walks
from tracewell.operators.hold import hold
from tracewell.operators.scoring import contained

# How many words a fragment has, how few a segment, a sentence; how many words and phrases are asked for.
FRAGMENT, SEGMENT, SENTENCE, TOPIC_WORDS, PHRASES = 8, 5, 8, 4, 3
_CLOSES = ",;:.!?)"


def _bared(c: Column, kept: str = "") -> Column:
    """The words (word, bare) of a text with single blanks, bare in lower case and of letters, digits and what is kept alone; found for the whole text at
    once, since an expression for each word costs much more."""
    bare = F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}} {kept}]+", "")
    return F.zip_with(F.split(c, " "), F.split(bare, " "), lambda w, b: F.struct(w.alias("word"), b.alias("bare")))


def topic_words(docs: DataFrame, most: int = TOPIC_WORDS) -> DataFrame:
    """Id, topic: the first words of the two longest runs of content words of docs(id, text), in the order of the text.  Punctuation
    behind a word ends a run; of equally long runs the earlier counts.  One fold over a text's words, whose state is the run that is open and
    the two longest before it: nothing is exchanged."""
    marked = F.transform(_bared(F.col("spaced"), "-"), lambda x: F.struct(x["bare"].alias("word"), F.substring(x["word"], -1, 1).isin(*_CLOSES).alias("closes"), text.is_content_word(x["bare"]).alias("content")))
    run = "named_struct('size', {0}, 'place', {1}, 'words', {2})".format
    none = run("0", "0", "cast(array() AS array<string>)")
    state = "named_struct('on', {0}, 'open', {1}, 'first', {2}, 'second', {3}, 'place', s.place + 1)".format
    start = f"named_struct('on', false, 'open', {none}, 'first', {none}, 'second', {none}, 'place', 0)"
    first, second = "IF(s.open.size > s.first.size, s.open, s.first)", "IF(s.open.size > s.first.size, s.first, IF(s.open.size > s.second.size, s.open, s.second))"
    on = state("NOT x.closes", run("s.open.size + char_length(x.word)", "s.open.place", f"IF(size(s.open.words) < {most}, array_append(s.open.words, x.word), s.open.words)"), "s.first", "s.second")
    new = state("NOT x.closes", run("char_length(x.word)", "s.place", "array(x.word)"), first, second)
    off = state("false", "s.open", "s.first", "s.second")
    two = f"array_sort(array({first}, {second}), (a, b) -> a.place - b.place)"
    topic = F.expr(f"aggregate(marked, {start}, (s, x) -> IF(NOT x.content, {off}, IF(s.on, {on}, {new})), s -> slice(flatten(transform({two}, r -> r.words)), 1, {most}))")
    spaced = docs.select("id", F.regexp_replace("text", text.BLANKS, " ").alias("spaced"))
    return spaced.select("id", marked.alias("marked")).select("id", F.coalesce(topic, F.array().cast("array<string>")).alias("topic"))


def distinctive_fragment(docs: DataFrame) -> DataFrame:
    """Id, fragment: of all windows of eight words (of a whole segment of five to seven) that have three telling words, the first
    with the greatest score: rare-looking words, digits, capitals within.  Scores are whole sixtieths, so equal ones are equal.

    A word's mark is one number that holds its score, its capital and whether it tells, so one sum adds all three; sums over eight words
    are made by doubling."""
    segments = F.transform(F.split(F.regexp_replace("text", text.BLANKS, " "), "¦"), lambda s: F.filter(_bared(s), lambda x: x["bare"] != ""))
    part = lambda m, k: F.shiftright(m, 20 * k).bitwiseAND(F.lit((1 << 20) - 1))
    none, tells, capital = F.lit(0).cast("long"), F.lit(1 << 40), F.lit(18 << 20).cast("long")

    def mark(x):
        word, bare = x["word"], x["bare"]
        score = 24 + 3 * F.least(F.char_length(bare), F.lit(12)) + F.when(bare.rlike(r"[0-9]"), 30).otherwise(0)
        return F.when(~bare.isin(*text.GENERIC_WORDS), tells + F.when(word.rlike(r"^\p{Lu}"), capital).otherwise(none) + score).otherwise(none)

    def with_next(a, step):
        return F.get(F.transform(F.array(a), lambda v: F.transform(v, lambda x, i: x + F.coalesce(F.get(v, i + step), F.lit(0)))), F.lit(0))

    def windows(m, k):
        sums, step = m, 1
        while step < FRAGMENT:
            sums, step = with_next(sums, step), 2 * step
        score = lambda c, i: F.when(part(c, 2) >= 3, part(c, 0) + part(c, 1) - part(F.get(m, i), 1)).otherwise(-1)
        return F.array_max(F.transform(F.slice(sums, 1, F.greatest(F.size(m) - (FRAGMENT - 1), F.lit(1))), lambda c, i: F.struct(score(c, i).alias("score"), (-k).alias("segment"), (-i).alias("start"))))

    rows = docs.select("id", F.filter(segments, lambda s: F.size(s) >= SEGMENT).alias("segments"))
    rows = rows.withColumn("marks", F.transform("segments", lambda s: F.transform(s, mark)))
    best = F.array_max(F.transform("marks", windows))
    said = F.expr(f"array_join(slice(segments[-best.segment].word, 1 - best.start, {FRAGMENT}), ' ')")
    plain = F.regexp_replace(F.regexp_replace(said, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), '"', "")
    return rows.withColumn("best", best).select("id", F.when(F.col("best.score") >= 0, F.nullif(plain, F.lit(""))).alias("fragment"))


def fingerprint_sentences(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(run, id, sentence): sentences of eight words and more, without case names and quotes, of the paragraphs of docs(id, text) that
    name the known error ``run`` of known_keys(), and of their neighbours; by their match keys, each once."""
    paragraphs = docs.select("id", F.posexplode(F.split("text", "\n")).alias("place", "paragraph"))
    named = hold(paragraphs.select("id", "place", "paragraph", contained(text.match_key(F.col("paragraph")), keys, "match").alias("runs")))
    near = named.select("id", F.explode("runs").alias("run"), F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("place")).distinct()
    around = near.join(named.select("id", "place", "paragraph"), ["id", "place"]).groupBy("run", "id").agg(F.array_sort(F.collect_list(F.struct("place", "paragraph"))).alias("ps"))
    whole = F.array_join(F.transform("ps", lambda p: p["paragraph"]), " ")
    parts = around.select("run", "id", F.explode(F.split(whole, r"(?<=[.!?])\s+")).alias("s")).select("run", "id", F.regexp_replace(F.trim("s"), r"[.!?]+$", "").alias("s"))
    long = parts.where((F.size(F.split("s", " ")) >= SENTENCE) & ~F.contains("s", F.lit('"')))
    return long.withColumn("names", walks.case_names_of("s")).where("size(names) = 0").select("run", "id", text.match_key(F.col("s")).alias("sentence")).distinct()


def phrase_queries(sentences: DataFrame, most: int = PHRASES) -> DataFrame:
    """(run, n, phrase, df): of each run's sentences those that fewest of its documents have, the longest first, then by text."""
    counted = sentences.groupBy("run", F.col("sentence").alias("phrase")).agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("run").orderBy("df", F.desc(F.char_length("phrase")), "phrase")
    return counted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(run, n, phrase, df, id): the documents whose text has the phrase, all phrases in one pass over the texts."""
    asked = hold(phrases)
    keys = asked.select("phrase").distinct().withColumn("id", F.xxhash64("phrase"))
    found = docs.select("id", F.explode(contained(text.match_key(F.col("text")), keys.select("id", F.col("phrase").alias("match")), "match")).alias("key"))
    return asked.withColumn("key", F.xxhash64("phrase")).join(found, "key").select("run", "n", "phrase", "df", "id")
