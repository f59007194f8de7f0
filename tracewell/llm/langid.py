"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bit per language in every slot: a look-up of an n-gram reads HASHES slots, ANDs them
and returns all languages that contain the n-gram at once.  A text's n-grams are popcounted per language; with N
n-grams and a language whose bit is set in a share f of the slots, (count - N f**HASHES) / (1 - f**HASHES) corrects for false
positives.  The greatest corrected count decides, equal ones by name; its share of N is the score.

N-grams are four bytes of the lower-cased text, with every ASCII byte that is no letter as a space.  A language's filter holds
the n-grams that make up at least ``LEAST_SHARE`` of its own training n-grams, and at least a twentieth of the share in
any other language.

The filters are fitted on a bounded sample: about ``train_bytes`` bytes of whole texts in all, the same for each
language, chosen by a 62-bit hash of doc_id, so a language of any size has its share; texts over ``most_bytes`` are not learned from.
Everything is scored, texts of any length.

Null texts and texts without a letter are `und` with score 0.  A text with letters but no known n-gram gets the most
frequent language with score 0.  With no language to learn, all are `und`.  Rows are scored one by one: repeated rows, null
ids and an empty table need no rule of their own.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import _text
from tracewell.llm._spark import batch_rows, crc_mod, map_frames

GRAM, SLOTS_LOG2, HASHES = 4, 20, 2
LEAST_SHARE, LEAST_RATIO = 4e-6, 0.05
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalpha():
        _SPACE[_c] = 32


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that begins at each byte, whether it lies within one text, and where texts begin."""
    data, off = _text.joined([None if t is None else t.lower() for t in texts])
    d = _SPACE[np.concatenate([data, np.full(GRAM - 1, 32, np.uint8)])].astype(np.uint32)
    n = len(data)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | d[k : k + n]
    within = np.ones(n, bool)
    for k in range(GRAM - 1):
        within[np.maximum(off[1:] - 1 - k, off[:-1])] = False
    within &= code != 0x20202020
    return code, within, off


def slots(code: np.ndarray) -> list[np.ndarray]:
    """The filter slots of each n-gram: multiplicative hashes of 32 bits."""
    shift = np.uint32(32 - SLOTS_LOG2)
    return [(code * np.uint32(m)) >> shift for m in (2654435769, 2246822519)[:HASHES]]


class Filters:
    """The fitted filters: languages in order, the slots' bitmasks (one array per 64 languages), and bit densities."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], prior: str):
        self.languages = sorted(counts)
        self.prior = prior
        self.masks = []
        share = {k: (g, c / max(1, c.sum())) for k, (g, c) in counts.items()}
        every = np.unique(np.concatenate([g for g, _ in share.values()])) if share else np.zeros(0, np.uint32)
        most = np.zeros(len(every))
        for g, c in share.values():
            at = np.searchsorted(every, g)
            most[at] = np.maximum(most[at], c)
        for first in range(0, len(self.languages), 64):
            group = self.languages[first : first + 64]
            kind = np.uint8 if len(group) <= 8 else np.uint64
            mask = np.zeros(1 << SLOTS_LOG2, kind)
            for bit, lang in enumerate(group):
                g, c = share[lang]
                g = g[(c >= LEAST_SHARE) & (c >= LEAST_RATIO * most[np.searchsorted(every, g)])]
                for s in slots(g):
                    mask[s] |= kind(1 << bit)
            self.masks.append(mask)
        self.density = [float(np.mean((self.masks[i // 64] >> self.masks[i // 64].dtype.type(i % 64)) & self.masks[i // 64].dtype.type(1))) for i in range(len(self.languages))]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of each text, and the corrected count per text and language."""
        code, within, off = grams(texts)
        begin = off[:-1]
        n = np.add.reduceat(within.astype(np.int64), begin)
        at = slots(code)
        out = np.zeros((len(texts), len(self.languages)))
        for k, mask in enumerate(self.masks):
            hit = mask[at[0]]
            for s in at[1:]:
                hit &= mask[s]
            hit[~within] = 0
            for i in range(64 * k, min(64 * k + 64, len(self.languages))):
                one = hit.dtype.type(1 << (i % 64))
                seen = np.add.reduceat(((hit & one) != 0).astype(np.int64), begin)
                wrong = self.density[i] ** HASHES
                out[:, i] = (seen - n * wrong) / max(1e-9, 1 - wrong)
        return n, out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        known = np.array([t is not None and _LETTER.search(t) is not None for t in texts])
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        n, c = self.counts(texts)
        best = c.argmax(axis=1)
        top = c[np.arange(len(texts)), best]
        score = np.where(known & (n > 0), np.clip(top / np.maximum(n, 1), 0, 1), 0.0)
        return [("und" if not k else self.languages[b] if t > 0 else self.prior) for k, b, t in zip(known, best, top, strict=True)], score


def shares(sizes: dict[str, int], train_bytes: int) -> dict[str, int]:
    """Below which 62-bit hash a language's documents are learned from, so that each gives about as many bytes."""
    each = train_bytes / max(1, len(sizes))
    return {lang: int(2.0**62 * min(1.0, each / max(1, size))) for lang, size in sizes.items()}


def learn(docs: DataFrame, train_bytes: int = 16_000_000, most_bytes: int = 1_000_000) -> Filters:
    """Fits the filters on documents whose crc32 remainder is not 2."""
    taught = docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    totals = {r["lang"]: (r["n"], r["size"]) for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if not totals:
        return Filters({}, "und")
    drawn = F.expr("shiftrightunsigned(xxhash64(cast(doc_id AS string), 9), 2)")
    share = F.create_map([F.lit(x).cast(t) for lang, n in shares({k: size for k, (_, size) in totals.items()}, train_bytes).items() for x, t in ((lang, "string"), (n, "long"))])
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    gathered: dict[str, list[str]] = {lang: [] for lang in totals}
    for row in taught.where(drawn < share[F.col("lang")]).select("lang", "text").toLocalIterator():
        gathered[row["lang"]].append(row["text"])
    for lang, texts in gathered.items():
        code, within, _ = grams(texts or [""])
        counts[lang] = np.unique(code[within], return_counts=True)
    return Filters(counts, min(totals, key=lambda k: (-totals[k][0], k)))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text)."""
    batch_rows(docs.sparkSession, 1000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                lang, score = filters.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": lang, "score": score})

    rows = docs.select("doc_id", "text", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    return map_frames(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
