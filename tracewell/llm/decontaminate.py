"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters, digits and marks of any script; in scripts written without spaces each character is a word.  Seeds are windows of ``MIN_MATCH`` words (whole items, if shorter); a
document is tiled against the items with which it shares a seed.  Tiling looks up Karp-Rabin hashes of all windows of
the item among those of the document, joins hits that follow one another to maximal matches, and repeatedly marks the
longest one whose words are unmarked on both sides, cutting matches that earlier tiles have eaten into, until
none has ``MIN_MATCH`` words.  The share of an item's words under tiles is its coverage: the order of the tiles doesn't
matter, so reordered passages count in full.  Of equally long matches the first in the document, then in the item, is marked.

The benchmark is read in blocks of at most ``block_bytes`` of text; each is broadcast (so its size is bounded) and all documents
pass it once.  With more than one block, each block's result is written and its broadcast destroyed before the next is read.
Documents need no shuffle; a task holds some texts and what one of them shares with one item, which is linear in their words.

Items of fewer than ``MIN_MATCH`` words occur anywhere by chance: they match only documents that consist of just these words.
Null and empty texts, and items without words, match nothing.  Very long texts are tiled whole.  Each row of the documents is tiled by
itself, so repeated rows give repeated results; a null doc_id is given back.  Items with equal text each match.  An empty table on
either side gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tracewell.llm import _text
from tracewell.llm._spark import Scratch, batch_rows, filter_rows, map_frames

MIN_MATCH = 4
MOST_HITS = 200_000  # beyond that many common windows of MIN_MATCH words, tiles are looked for by length
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
# Han, kana, bopomofo, Yi, Thai, Lao, Myanmar, Khmer, Tai: written without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int, item_words int"


class _Spaced(dict):
    """Code point -> itself if it belongs to a word, set apart in scripts without spaces, else a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        inside = unicodedata.category(c)[0] in "LNM"
        self[code] = f" {c} " if inside and _UNSPACED.match(c) else c if inside else " "
        return self[code]


_SPACED = _Spaced()


def spaced(t: str | None) -> str | None:
    """The lower-cased text with its words set apart as far as ASCII separators don't do so."""
    t = t and t.lower()
    return t if not t or t.isascii() else _BEYOND_ASCII.sub(lambda m: m[0].translate(_SPACED), t)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The greedy tiling of two sequences of word hashes: (place in item, place in document, words), longest first."""
    a, b = _text.windows(item, least), _text.windows(doc, least)
    if not len(a) or not len(b):
        return []
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    if int((hi - lo).sum()) > MOST_HITS:
        return tiles_by_length(item, doc, least)
    js = np.repeat(np.arange(len(b)), hi - lo)
    if not len(js):
        return []
    is_ = order[_text.flat_ranges(lo[hi > lo], (hi - lo)[hi > lo])]
    # Hits on one diagonal that follow one another are one match.
    by = np.lexsort((is_, js - is_))
    i, j = is_[by], js[by]
    new = np.ones(len(i), bool)
    new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(i))) + least - 1
    heap = [(-int(n), int(q), int(p)) for p, q, n in zip(i[first], j[first], size, strict=True)]
    heapq.heapify(heap)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        taken = in_item[p : p + n] | in_doc[q : q + n]
        if not taken.any():
            in_item[p : p + n] = in_doc[q : q + n] = True
            out.append((p, q, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(heap, (s - e, q + s, p + s))
    return out


def _free(words: np.ndarray, marked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of n unmarked words."""
    power, inverse = _text.powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    gone = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(gone[n:] == gone[:-n]) if len(words) >= n else np.zeros(0, np.int64)
    return at, _text.mix((total[at + n] - total[at]) * inverse[at])


def tiles_by_length(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiling in memory linear in the words: the greatest length of a common unmarked window is found by bisection,
    its matches are marked, and so on down to the least length."""
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= least:
        lo, hi = least - 1, most
        while lo < hi:
            n = (lo + hi + 1) // 2
            lo, hi = (n, hi) if len(np.intersect1d(_free(item, in_item, n)[1], _free(doc, in_doc, n)[1])) else (lo, n - 1)
        if lo < least:
            break
        (p, hp), (q, hq) = _free(item, in_item, lo), _free(doc, in_doc, lo)
        places: dict[int, list[int]] = {}
        for x, h in zip(p[::-1].tolist(), hp[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(x)
        end = -1
        for y, h in zip(q.tolist(), hq.tolist(), strict=True):
            left = places.get(h)
            while y > end and left:
                x = left[-1]
                if in_item[x : x + lo].any():
                    left.pop()
                    continue
                in_item[x : x + lo] = in_doc[y : y + lo] = True
                out.append((x, y, lo))
                end = y + lo - 1
        most = lo
    return out


class Items:
    """Word hashes of benchmark items, and the seeds that lead to them."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        h, first = _text.words([spaced(t) for t in texts], _WORD)
        self.ids = ids
        self.words = [h[first[k] : first[k + 1]] for k in range(len(ids))]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                by_size.setdefault(n := min(MIN_MATCH, len(w)), []).append((_text.windows(w, n), k))
        for n, found in by_size.items():
            s = np.concatenate([x for x, _ in found])
            k = np.concatenate([np.full(len(x), k) for x, k in found])
            order = np.argsort(s, kind="stable")
            self.seeds[n] = s[order], k[order]
        # A bitmap over the seeds' low bits turns most windows away before the search.
        self.bits = {}
        for n, (s, _) in self.seeds.items():
            self.bits[n] = np.zeros(1 << 22, bool)
            self.bits[n][(s & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def leaks(self, texts: list[str | None], threshold: float) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item, coverage, tiles, longest tile, words of the item) of coverage at least the threshold."""
        h, first = _text.words([spaced(t) for t in texts], _WORD)
        pairs: set[tuple[int, int]] = set()
        for n, (seeds, items) in self.seeds.items():
            w = _text.windows(h, n)
            at = np.flatnonzero(self.bits[n][(w & np.uint64((1 << 22) - 1)).astype(np.int64)])
            lo = np.searchsorted(seeds, w[at], "left")
            hit = lo < len(seeds)
            hit[hit] = seeds[lo[hit]] == w[at[hit]]
            at, lo = at[hit], lo[hit]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[doc + 1]
            if n < MIN_MATCH:
                inside &= np.diff(first)[doc] == n
            at, lo, doc = at[inside], lo[inside], doc[inside]
            hi = np.searchsorted(seeds, w[at], "right")
            pairs.update(zip(np.repeat(doc, hi - lo).tolist(), items[_text.flat_ranges(lo, hi - lo)].tolist(), strict=True))
        out = []
        for d, k in sorted(pairs):
            item = self.words[k]
            found = tiles(item, h[first[d] : first[d + 1]], min(MIN_MATCH, len(item)))
            cover = sum(n for _, _, n in found) / len(item)
            if cover >= threshold:
                out.append((d, k, cover, len(found), max(n for _, _, n in found), len(item)))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 16_000_000) -> DataFrame:
    """One row for each document and benchmark item that it covers by at least the threshold."""
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    docs = docs.select("doc_id", "text")

    def against(items: list[tuple[int | None, str | None]]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(Items([i for i, _ in items], [t for _, t in items]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for batch in batches:
                for at in range(0, len(batch), 250):
                    part = batch.iloc[at : at + 250]
                    ids = part["doc_id"].tolist()
                    rows = known.leaks(part["text"].tolist(), threshold)
                    out = pd.DataFrame([r[2:] for r in rows], columns=["coverage", "n_tiles", "longest_tile", "item_words"])
                    out["doc_id"], out["item_id"] = pd.array([ids[r[0]] for r in rows], dtype="Int64"), pd.array([known.ids[r[1]] for r in rows], dtype="Int64")
                    yield out

        return map_frames(docs, run, SCHEMA), shared

    scratch, out = Scratch(spark, "leaks"), None
    for items, alone in blocks_of(benchmark, block_bytes):
        found, shared = against(items)
        if not alone:
            found = scratch.keep(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, bool]]:
    """The benchmark's blocks, each with whether it is the only one."""
    blocks = item_blocks(benchmark, block_bytes)
    held, n = next(blocks), 0
    for more in blocks:
        yield held, False
        held, n = more, n + 1
    yield held, n == 0


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of about that much text; one empty block for an empty benchmark."""
    held, size, made = [], 0, False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
        if size >= block_bytes:
            yield held
            held, size, made = [], 0, True
    if held or not made:
        yield held


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 16_000_000) -> DataFrame:
    """The documents that cover no item by the threshold, with all their columns."""
    batch_rows(docs.sparkSession, 1000)
    scratch = Scratch(docs.sparkSession, "leaks")
    for items, alone in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Items([i for i, _ in items], [t for _, t in items]))

        def clean(texts: list[str | None], shared=shared) -> np.ndarray:
            keep = np.ones(len(texts), bool)
            keep[[x[0] for x in shared.value.leaks(texts, threshold)]] = False
            return keep

        before, docs = docs, filter_rows(docs, clean)
        if not alone:
            docs = scratch.keep(docs, before)
            shared.destroy()
    return docs
