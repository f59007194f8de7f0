"""Spelling variants: words one insertion, deletion or replacement apart, by bands of letter-parity masks.

Every word has a mask: for each letter one bit, whether it occurs an odd number of times.  One edit flips at most two bits, so of three bands
that the letters are dealt into at least one is the same in both words.  Words are joined on equal bands, with a length filter in the
key: a pair belongs to the length of its shorter word, so a word has keys as the shorter and as the longer.  Bands of frequent letters
agree in many words; so the key also has a half of the word: an edit leaves the first or the last half as it is.  Nothing is lost by that
and no group is hot that does not share half its letters.  Pairs are verified in the join, so candidates are never rows, and a pair counts
in its first agreeing band and half only.

Texts are reduced to counts of words in their tasks, these are summed by a shuffle of words, and all later steps are on distinct words.
Of a word's near words the most frequent that is at least ``ratio`` times as frequent is its form; forms of forms lead to a root, by
doubling pointers: frequencies grow by the ratio with each step, so a few rounds do.

Null texts have no words; a null doc_id is taken as empty in what is hashed.  Very long texts are read whole, very long runs of letters
are words like others.  Repeated rows count again.  Of equally frequent forms the first in the order of code points wins.  An empty table
gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import _text
from tracewell.llm._spark import Scratch, batch_rows, partitions

LETTERS, LEAST, RATIO, BANDS = 6, 5, 5, 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LONG = 64  # bytes; the few longer runs are hashed one by one


def crc_table() -> np.ndarray:
    """The table of the usual CRC-32, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = crc_table()


def crc_of_runs(data: np.ndarray, s: np.ndarray, e: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[s:e], going on from the CRC before it; all runs at once, byte by byte."""
    size = e - s
    by = np.argsort(-size, kind="stable")
    state = ~before.astype(np.uint32)[by]
    at, size = s[by], size[by]
    long = int(np.searchsorted(-size, -_LONG))  # runs over the limit come first
    for j in range(int(size[long]) if long < len(size) else 0):
        k = int(np.searchsorted(-size, -j))
        live = slice(long, k)
        state[live] = _CRC[(state[live] ^ data[at[live] + j]) & 0xFF] ^ (state[live] >> 8)
    out = np.empty(len(s), np.uint32)
    out[by] = ~state
    for i in by[:long].tolist():
        out[i] = zlib.crc32(data[s[i] : e[i]].tobytes(), int(before[i]))
    return out


def runs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with ASCII capitals in lower case, where each run of Latin letters begins and ends, and of which text it is."""
    data, off = _text.joined(texts)
    inside = _LETTER[data]
    lead = np.flatnonzero(data == 0xC3)  # the letters from U+00C0 to U+00FF, and the two signs among them
    inside[lead] = inside[lead + 1] = True
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return _text.LOWER[data], s, e, np.searchsorted(off, s, "right") - 1


def word_counts(docs: DataFrame, letters: int = LETTERS, gaps: int = 0) -> DataFrame:
    """(word, n): how often each word of at least that many letters occurs in docs(doc_id, text).  gaps: of a run whose CRC-32, with doc_id
    and a colon before it, is divisible by that, the letter at the CRC modulo the run's length is left out first."""
    batch_rows(docs.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, s, e, row = runs_of(batch.column("text").to_pylist())
            extra: list[str] = []
            size = e - s - np.diff(np.concatenate([[0], np.cumsum(data == 0xC3)])[np.stack([s, e])], axis=0)[0]
            whole = size >= letters
            if gaps:
                ids = batch.column("doc_id").to_pylist()
                before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                h = crc_of_runs(data, s, e, before[row])
                for i in np.flatnonzero(h % gaps == 0).tolist():
                    letter = data[s[i] : e[i]].tobytes().decode()
                    at = int(h[i]) % len(letter)
                    extra.append(letter[:at] + letter[at + 1 :])
                    whole[i] = False
            s, e = s[whole], e[whole]
            h = _text.range_hashes(data, s, e)
            code, distinct = pd.factorize(h)
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            n = np.bincount(code, minlength=len(distinct)).astype(np.int64)
            s, e = s[first], e[first]
            ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
            words = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(data[_text.flat_ranges(s, e - s)]))
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])
            extra = [w for w in extra if len(w) >= letters]
            if extra:
                yield pa.RecordBatch.from_arrays([pa.array(extra, pa.string()), pa.array(np.ones(len(extra), np.int64))], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def parity_band(word: Column, band: int, bands: int = BANDS) -> Column:
    """The bits of the letters of one band: letters are dealt to bands in turn, a to z and then those from U+00C0 on."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    place = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 0xC0, 0xC0 - 26).otherwise(97)
    return F.aggregate(
        F.filter(F.transform(letters, place), lambda p: F.pmod(p, F.lit(bands)) == band),
        F.lit(0).cast("long"),
        lambda mask, p: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(p / bands).cast("int"))),
    )


def near_pairs(words: DataFrame, shortest: int = LETTERS) -> DataFrame:
    """(a, a_n, b, b_n) for words(word, n), each word once: the pairs one edit apart, each once; words of at least that many letters."""
    bands = [f"m{k}" for k in range(BANDS)]
    rows = words.select("word", "n", F.char_length("word").alias("size"), *[parity_band(F.col("word"), k).alias(c) for k, c in enumerate(bands)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(c).alias("value"), F.lit(side).alias("side")) for k, c in enumerate(bands) for side in (0, 1)]))

    def keyed(shorter: int) -> DataFrame:
        """Rows with the length of the shorter word of the pair: the word's own, or one less."""
        out = rows.withColumn("short", F.col("size") - shorter).where(F.col("short") >= shortest).select("*", each.alias("k")).select("*", "k.*").drop("k")
        half = F.expr("IF(side = 0, left(word, short div 2), right(word, short - short div 2))")
        return out.withColumn("key", F.xxhash64("short", "side", half, "band", "value")).drop("value").withColumn("longer", F.lit(shorter == 1))

    a, b = keyed(0).alias("a"), keyed(0).unionByName(keyed(1)).alias("b")
    same = [f"a.{c} = b.{c}" for c in bands]
    in_band = " OR ".join(f"(a.band = {k} AND {' AND '.join([same[k], *[f'NOT ({x})' for x in same[:k]]])})" for k in range(BANDS))
    front = "left(a.word, a.short div 2) = left(b.word, a.short div 2)"
    verify = f"a.key = b.key AND a.short = b.short AND a.band = b.band AND a.side = b.side AND (b.longer OR a.word < b.word) AND ({in_band}) AND (a.side = 0 OR NOT ({front})) AND levenshtein(a.word, b.word, 1) = 1"
    return a.join(b, F.expr(verify)).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, ratio: int = RATIO, gaps: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs(doc_id, text) that have at least that many letters and occur that often."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(word_counts(docs, letters, gaps).where(F.col("n") >= least))
    pairs = near_pairs(words.repartition(partitions(docs.sparkSession), "word"), letters)
    # Either word of a pair is near the other.
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    formed = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    rows = words.join(best, "word", "left").select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.n")).alias("form_n"))
    rows = scratch.keep(rows, words)
    # Words with a form, and how far their pointer has got; doubled until none moves on.
    at = scratch.keep(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = scratch.keep(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), at)
    return rows.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
