"""Text walks that keep state from word to word, as Arrow-batched functions: case names, common substrings, known
keys within texts.  All else about text is in ``text.py``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.functions.text import DASHES, DOUBLE_QUOTES, SINGLE_QUOTES

_SWAP = str.maketrans({**dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **dict.fromkeys(DASHES, "-")})
_BLANK = re.compile("[\\s​﻿]+")
# What a word of a party looks like, its little words, words that open a citation, and the limits of the walk.
_NAMED = re.compile(r"[A-Z][\w'&.-]*", re.A)
_LITTLE = frozenset(("of", "the", "de", "la", "&"))
_OPENERS = frozenset("See Cf In Also Compare Accord But Citing Under Per From And The".split())
_BEFORE, _AFTER, _WORDS_BEFORE, _WORDS_AFTER = 80, 100, 4, 5


def canonical(s: str | None) -> str:
    return _BLANK.sub(" ", unicodedata.normalize("NFKC", s or "").translate(_SWAP)).strip()


def words(s: str) -> list[str]:
    return [w for w in (x.strip(".-") for x in re.sub(r"[^a-z0-9.\s-]", " ", canonical(s).lower()).split()) if w]


def _named_span(flags: list[str]) -> tuple[int, int]:
    """From the first to behind the last capitalised word of a party, by one letter per word: C capitalised, o little."""
    line = "".join(flags)
    return line.find("C"), line.rfind("C") + 1


def _kind(word: str) -> str:
    return "C" if _NAMED.fullmatch(word) else "o" if word in _LITTLE else "-"


def _before(chunk: str) -> list[str]:
    """The party that ends where the chunk does."""
    words = chunk.split(" ")[-_WORDS_BEFORE:]
    kinds = [_kind(w) if w and w[-1] not in ",;:." else "-" for w in words]
    words, kinds = words[(cut := "".join(kinds).rfind("-") + 1) :], kinds[cut:]
    skip = next((i for i, w in enumerate(words) if w not in _OPENERS), len(words))
    return [words[skip:][i] for i in range(*_named_span(kinds[skip:]))] if "C" in kinds[skip:] else []


def _after(chunk: str) -> list[str]:
    """The party with which the chunk begins; punctuation behind a word ends it."""
    words = chunk.split(" ")[:_WORDS_AFTER]
    bare = [w.rstrip(",;:.)?!") for w in words]
    ends = next((i + 1 for i, (w, x) in enumerate(zip(words, bare, strict=True)) if w != x), len(words))
    kinds = "".join(map(_kind, bare[:ends])).split("-")[0]
    return bare[slice(*_named_span(list(kinds)))] if "C" in kinds else []


def case_names(s: str | None) -> list[str]:
    """Names `A v. B`: at most four capitalised words before, five after, up to punctuation; each once, in order."""
    text = canonical(s)
    marks = [i for i in range(len(text) - 3) if text.startswith(" v. ", i)] if " v. " in text else []
    sides = ((_before(text[max(0, i - _BEFORE) : i]), _after(text[i + 4 : i + 4 + _AFTER])) for i in marks)
    names = (" v. ".join(re.sub(r"[,;:.)?!]+$", "", " ".join(x)) for x in two) for two in sides if all(two))
    return list(dict.fromkeys(names))


def case_key(s: str) -> str:
    return re.sub(r"\s*-\s*", "-", canonical(s).lower())


def edits(a: str, b: str, most: int) -> int:
    """T8 up to most, else more: a band of the distance table."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = np.arange(len(b) + 1)
    y = np.array([ord(c) for c in b], np.int64)
    for i, c in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != ord(c)))])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if row.min() > most:
            return most + 1
    return int(row[-1])


class Citations:
    """Known citations by key and by first party, in their order."""

    def __init__(self, known: list[str]):
        self.exact: dict[str, int] = {}
        self.near: dict[str, list[tuple[int, str]]] = {}
        self.known = known
        for i, citation in enumerate(known):
            key = case_key(citation)
            self.exact.setdefault(key, i)
            parties = key.split(" v. ")
            if len(parties) > 1 and parties[0] and len(parties[1]) >= 5:
                self.near.setdefault(parties[0], []).append((i, parties[1]))

    def match(self, name: str) -> tuple[str, bool] | None:
        """The first citation that the name is, or is a misspelling of: the same first party, a second one within two edits."""
        key = case_key(name)
        parties = key.split(" v. ")
        found = [(self.exact[key], False)] if key in self.exact else []
        if len(parties) > 1 and parties[0] and parties[1]:
            found += [(i, True) for i, other in self.near.get(parties[0], ()) if edits(parties[1], other, 2) <= 2]
        best = min(found, default=None)
        return best and (self.known[best[0]], best[1])


def matched_citations(spark, known: list[str]):
    """T6, T9 on a text column: struct(case_names, citations, variants); known is a request's list."""
    shared = spark.sparkContext.broadcast(Citations(known))
    names = ArrayType(StringType())

    @F.pandas_udf(StructType([StructField("case_names", names), StructField("citations", names), StructField("variants", names)]))
    def matched(s: pd.Series) -> pd.DataFrame:
        rows = []
        for found in s.map(case_names):
            hits = [(n, shared.value.match(n)) for n in found]
            rows.append((found, list(dict.fromkeys(h[0] for _, h in hits if h)), list(dict.fromkeys(n for n, h in hits if h and h[1]))))
        return pd.DataFrame(rows, columns=["case_names", "citations", "variants"])

    return matched


def longest_common_substring(a: str, b: str) -> int:
    """T17, a row of the table at a time."""
    if not a or not b:
        return 0
    y = np.array([ord(c) for c in b], np.int32)
    row, best = np.zeros(len(b) + 1, np.int32), 0
    for c in a:
        row[1:] = np.where(y == ord(c), row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def check_passage(passage: str, page: str, names: list[str], same_url: bool = True) -> tuple[bool, str]:
    """Is the passage on the page, exactly or in one long run, with the names that it mentions?"""
    passage, page = canonical(passage), canonical(page)
    if not passage or not same_url:
        return False, "empty" if not passage else "page changed"
    named = [n for n in map(canonical, names) if n and n in passage]
    if not named or any(n not in page for n in named):
        return False, "no name" if not named else "name not on page"
    if passage in page:
        return True, "exact"
    enough = longest_common_substring(passage, page) >= max(40, -(-len(passage) * 6 // 10))
    return (True, "contiguous") if enough else (False, "too short a run")


@F.pandas_udf(ArrayType(StringType()))
def case_names_of(s: pd.Series) -> pd.Series:
    return s.map(case_names)


@F.pandas_udf(IntegerType())
def common_substring_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common_substring(canonical(x), canonical(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def small_batches(spark) -> None:
    """Python gets a few MB of rows at a time, however long they are: what a worker holds does not grow with a table's files."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def key_blocks(keys, block_bytes: int = 16_000_000) -> Iterator[dict[bytes, list[int]]]:
    """The rows of keys(id, key) as key -> ids, in blocks of about that much text; null and empty keys are in no text."""
    held, size = {}, 0
    for i, key in keys.toLocalIterator():
        if key:
            held.setdefault(key.encode(), []).append(i)
            size += len(key) + 100
        if size >= block_bytes:
            yield held
            held, size = {}, 0
    if held:
        yield held


def _rolled(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes, a power of two, from each place on: of twice as many bytes from those of both halves."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    out, step = data.astype(np.uint32), 1
    while step < n:
        out = out[:-step] * np.uint32(0x9E3779B1) + out[step:]
        out ^= out >> np.uint32(15)
        step *= 2
    return out * np.uint32(0x85EBCA6B)


_FIRST_BITS, CHUNK = 18, 1_000_000


class Keys:
    """Keys by their first bytes, at most 16: a place of a text is compared with a key only where those agree."""

    def __init__(self, ids: dict[bytes, list[int]]):
        self.ids, heads = ids, {}
        for key in ids:
            n = 1 << min(4, len(key).bit_length() - 1)
            heads.setdefault(n, {}).setdefault(int(_rolled(np.frombuffer(key[:n], np.uint8), n)[0]), []).append(key)
        self.heads = {}
        for n, by in heads.items():
            starts = np.zeros(1 << _FIRST_BITS, bool)
            starts[np.array(list(by), np.uint32) >> np.uint32(32 - _FIRST_BITS)] = True
            self.heads[n] = np.sort(np.array(list(by), np.uint32)), by, starts

    def within(self, body: str | None) -> list[int]:
        return self.within_all([body])[0]

    def within_all(self, bodies: list[str | None]) -> list[list[int]]:
        """For each text; short ones are searched together, about CHUNK bytes at a time."""
        out, rows, size = [], [], 0
        for body in bodies:
            rows.append((body or "").encode())
            size += len(rows[-1])
            if size >= CHUNK:
                out += self._within(rows)
                rows, size = [], 0
        return out + self._within(rows) if rows else out

    def _within(self, rows: list[bytes]) -> list[list[int]]:
        raw, ends = b"".join(rows), np.cumsum([len(r) for r in rows])
        data, found = np.frombuffer(raw, np.uint8), [set() for _ in rows]
        for n, (heads, by, starts) in self.heads.items():
            h = _rolled(data, n)
            # Few places have the first bits of a key's hash; only those are looked up.
            places = np.flatnonzero(starts[h >> np.uint32(32 - _FIRST_BITS)])
            h = h[places]
            same = heads[np.minimum(np.searchsorted(heads, h), len(heads) - 1)] == h
            places, h = places[same], h[same]
            for p, x, r in zip(places.tolist(), h.tolist(), np.searchsorted(ends, places, "right").tolist(), strict=True):
                found[r].update(key for key in by[x] if key not in found[r] and p + len(key) <= ends[r] and raw.startswith(key, p))
        return [sorted(i for key in keys for i in self.ids[key]) for keys in found]


def keys_within(spark, block: dict[bytes, list[int]]):
    """A function of a text column: the ids of the block's keys that the text contains."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Keys(block))

    @F.pandas_udf(ArrayType(LongType()))
    def within(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.within_all(s.tolist()), index=s.index, dtype=object)

    return within
