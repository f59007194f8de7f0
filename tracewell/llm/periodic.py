"""Periodic runs: stretches of a text whose words repeat with a period four times and more, by bit-parallel lags.

The ids of a text's words are laid out as bit planes, one big integer a bit of the id with one bit a word.  For a lag q each plane is XORed with
itself shifted by q and the results are ORed: a zero stands where a word equals the one q on.  ANDs of the inverse with itself, shifted by
1, 2, 4 and so on, leave the places where a zero stretch is long enough begins.  Three things, which change no result, keep the number of lags
small: a run lies in a stretch of words that occur four times in it; a lag must have equal words at some consecutive places of a grid
through each long enough stretch; and a stretch found with a divisor of a lag has a smaller period.

A text is one row: no shuffle.  Null and empty texts have no run, nor do short ones; a null doc_id is carried along, its decimal is taken
as empty.  Very long texts are read whole: a lag costs a few operations on integers of as many bits as words.  Repeated rows are treated
one by one.  Ties go to the first start, then the least period.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._spark import batch_rows, map_frames

LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Run(NamedTuple):
    start: int
    length: int
    period: int


def planes(ids: np.ndarray) -> list[int]:
    """One integer a bit of the ids, the first word at the lowest place."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(bits)]


def equal_at(layers: Sequence[int], n: int, lag: int) -> int:
    """Ones where a word equals the one lag on."""
    differ = 0
    for x in layers:
        differ |= x ^ (x >> lag)
    return ~differ & ((1 << (n - lag)) - 1)


def stretches(ones: int, least: int) -> list[tuple[int, int]]:
    """The maximal stretches of at least that many ones, as first and end."""
    left, width = ones, 1
    while width < least and left:
        step = min(width, least - width)
        left &= left >> step
        width += step
    if not left:
        return []
    first, last = left & ~(left << 1), left & ~(left >> 1)
    return [(a, b + least) for a, b in zip(_places(first), _places(last), strict=True)]


def _places(bits: int) -> list[int]:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def frequent(ids: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of at least that many words of which each occurs so often: no run crosses their ends."""
    todo, out = [(0, len(ids))], []
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        part = ids[a:b]
        _, code, count = np.unique(part, return_inverse=True, return_counts=True)
        often = np.zeros(len(part) + 2, np.int8)
        often[1:-1] = count[code] >= times
        if often[1:-1].all():
            out.append((a, b))
            continue
        edge = np.diff(often)
        todo += [(a + int(s), a + int(e)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return sorted(out)


def possible(ids: np.ndarray, lag: int, least: int) -> bool:
    """May least equal pairs follow one another?  Those cover so many places of a grid, one after another, where words are equal, too."""
    step = max(1, least // 4)
    same = ids[: len(ids) - lag : step] == ids[lag::step]
    need = least // step
    if need <= 1:
        return bool(same.any())
    run = same
    for k in range(1, need):
        run = run[:-1] & same[k:]
        if not run.any():
            return False
    return True


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All maximal stretches with their smallest period q and a length of at least ``least`` and times * q, by start and period."""
    out = []
    for a, b in frequent(ids, times, least):
        part = np.unique(ids[a:b], return_inverse=True)[1]
        n, layers, seen = b - a, planes(part), {}
        for q in range(1, n // times + 1):
            need = max(least, times * q) - q
            if need >= 24 and not possible(part, q, need):
                continue
            for s, e in stretches(equal_at(layers, n, q), need):
                # A stretch that has been seen has a smaller period, which divides this one.
                if seen.setdefault((s, e + q), q) == q:
                    out.append(Run(a + s, e + q - s, q))
    return sorted(out)


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words of one document in ten, by its id: from one place on, the first few are repeated to the end."""
    h = zlib.crc32(b"" if doc_id is None or doc_id is pd.NA else str(int(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(words: list[bytes], found: Sequence[Run]) -> list[bytes]:
    """The words, of each run only its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for r in found:
        gone[r.start + r.period] += 1
        gone[r.start + r.length] -= 1
    return [w for w, k in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not k]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words have equal ids, counted up from 0."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def detect(docs: DataFrame, alter: bool = False) -> DataFrame:
    """docs(doc_id, text): each document's number of words, its runs by start and period, and the text with each run collapsed to its first
    period, words joined by one space.  alter: repeat words of one document in ten first (see planted())."""
    batch_rows(docs.sparkSession, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, found, texts = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space alone
                words = planted(words, doc_id) if alter else words
                counts.append(len(words))
                found.append(runs(word_ids(words)))
                texts.append(b" ".join(collapse(words, found[-1])).decode("utf-8", "replace"))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": counts, "runs": [[r._asdict() for r in x] for x in found], "collapsed": texts})

    return map_frames(docs.select("doc_id", "text"), run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """detect()'s rows as figures: the run with the greatest length / period, compared exactly, and digests of all runs and of the text."""
    better = "x.length * best.period > best.length * x.period"  # runs are in order, so ties stay with the first
    best = F.expr(f"aggregate(runs, get(runs, 0), (best, x) -> IF({better}, x, best))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
