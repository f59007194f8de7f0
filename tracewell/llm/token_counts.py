"""Token counts per section, from one encoding of the whole document.

Each document is encoded once, with the character span of every token.  Token spans are interval-joined to the
sections' spans (both in order, so the join is a search of token starts and ends among section starts), and every token is
allocated by rule:

``start``     to the section with its first character
``end``       to the section with its last character
``majority``  to the section with most of its characters, the earlier of equals (the default)

A token that lies in no section is counted for the section before it, or for the first.  n_crossing counts the tokens that a section
was given although they reach beyond it.  Summed over a document's sections, n_tokens is its whole token count, which counting
section by section would not give.

Sections are the lines of a text, those over ``width`` characters cut every ``width``.  A null or empty text has one section
of no characters and no tokens.  Every row is counted by itself: repeated rows give repeated sections, null ids are carried along.
An empty table gives no rows.  Very long texts are encoded whole.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracewell.llm import _text, _tokens
from tracewell.llm._spark import batch_rows, map_frames

SCHEMA = "doc_id long, section int, start_char int, end_char int, n_tokens int, n_crossing int"


def lines(text: str, width: int) -> list[tuple[int, int]]:
    """Spans of the lines, without their ends, cut every width characters; blank lines are sections too."""
    out, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        if len(line) <= width:
            out.append((at, end))
        else:
            out += [(a, min(a + width, end)) for a in range(at, end, width)]
        at = end + 1
    return out


def allocate(lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For token spans, the section each is allocated to and whether it reaches beyond it; sections are disjoint and in order."""
    first = np.maximum(np.searchsorted(starts, lo, "right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, np.maximum(hi - 1, lo), "right") - 1, 0)
    if rule == "start":
        to = first
    elif rule == "end":
        to = last
    elif rule == "majority":
        to = first.copy()
        c = np.flatnonzero(last > first)
        most = np.minimum(hi[c], ends[first[c]]) - np.maximum(lo[c], starts[first[c]])
        step = 1
        while len(c):
            k = first[c] + step
            n = np.minimum(hi[c], ends[k]) - np.maximum(lo[c], starts[k])
            to[c] = np.where(n > most, k, to[c])
            most = np.maximum(n, most)
            step += 1
            more = first[c] + step <= last[c]
            c, most = c[more], most[more]
    else:
        raise ValueError(f"unknown rule: {rule}")
    return to, (lo < starts[to]) | (hi > ends[to])


def count(docs: DataFrame, tokenizer: str, rule: str = "majority", width: int = 1000, spans: Callable[[str, int], list[tuple[int, int]]] = lines) -> DataFrame:
    """One row per section of docs(doc_id, text)."""
    batch_rows(docs.sparkSession, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _tokens.encoder(tokenizer, True)
        for batch in batches:
            for a in range(0, len(batch), 100):
                part = batch.iloc[a : a + 100]
                texts = [t or "" for t in part["text"].tolist()]
                _, n, lo, hi = enc.encode(texts)
                found = [spans(t, width) for t in texts]
                sizes = np.array([len(f) for f in found])
                flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
                # Documents get ranges of characters of their own, so one search serves the batch.
                base = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])[:-1]
                shift = np.repeat(base, sizes)
                to, beyond = allocate(lo + np.repeat(base, n), hi + np.repeat(base, n), flat[:, 0] + shift, flat[:, 1] + shift, rule)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array[np.repeat(np.arange(len(texts)), sizes)],
                        "section": _text.flat_ranges(np.zeros(len(sizes), np.int64), sizes),
                        "start_char": flat[:, 0],
                        "end_char": flat[:, 1],
                        "n_tokens": np.bincount(to, minlength=len(flat)),
                        "n_crossing": np.bincount(to[beyond], minlength=len(flat)),
                    }
                )

    return map_frames(docs.select("doc_id", "text"), run, SCHEMA)
