"""Best-fit packing into several permitted sequence lengths.

Each task packs its own partition in blocks of ``block`` pieces, longest first: a piece goes to the open bin that it
fills best; if none has room, a bin opens.  Its size is chosen jointly with what is still to come: for every permitted length that holds
the piece, the bin is filled on trial with the longest of the remaining pieces that fit, and the length with the least cost per token filled is
opened (the lesser, if equal).  A sequence of c tokens costs c + c**2 / attention + overhead: long sequences pay for attention, short ones for
what every sequence costs.  Finally every bin shrinks to the least permitted length that holds its contents.  Documents longer than the
greatest length are cut into pieces; no piece is dropped.

No shuffle and no state beyond one block: a lost task packs the same rows in the same order again, so bin ids, made
of the task's partition and a counter, do not change.  Where rows stand in the input decides which share a bin.

Null or negative lengths count as 0; a length of 0 gives one empty piece in a bin of its block.  Null texts are empty: they have only the end
mark.  Very long texts are encoded whole, then cut.  Repeated rows are packed one by one; a null doc_id is carried along.  Of equal pieces the
first comes first.  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import _tokens
from tracewell.llm._spark import batch_rows, map_frames

CAPACITIES, OVERHEAD, ATTENTION, BLOCK, END = (1024, 2048, 4096, 8192, 16384), 64, 32768, 8192, 2
SCHEMA = "doc_id long, piece int, piece_start long, piece_length int, bin_id long, bin_capacity int, bin_start int"


def cost(c: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return c + c * c / attention + overhead


def trial(left: list[int], at: int, room: int) -> int:
    """How much of room the longest of left[:at] (ascending) that fit would fill, one after another."""
    filled = 0
    while room > 0 and at > 0:
        at = min(at, bisect_right(left, room, 0, at)) - 1
        if at < 0 or not left[at]:
            break
        filled += left[at]
        room -= left[at]
    return filled


def pack_block(lengths: Sequence[int], capacities: Sequence[int], overhead: int, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length (none over the greatest capacity): its bin, where it starts there, and the bin's final capacity."""
    caps = sorted(capacities)
    n = len(lengths)
    bins, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    fill: list[int] = []
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    left = [int(lengths[i]) for i in order[::-1]]  # ascending; what comes after piece k is left[: n - 1 - k]
    for k, i in enumerate(order):
        size = int(lengths[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room = min((c for c in caps if c >= size), key=lambda c: (cost(c, overhead, attention) / max(1, size + trial(left, n - 1 - k, c - size)), c))
            b = len(fill)
            fill.append(0)
        bins[i], starts[i] = b, fill[b]
        fill[b] += size
        insort(free, (room - size, b))
    final = np.array([caps[bisect_left(caps, f)] for f in fill], np.int64)
    return bins, starts, final[bins] if n else final


def _packed(docs: DataFrame, sized: Callable[[pd.DataFrame], Iterator[tuple[pd.DataFrame, np.ndarray, list | None]]], capacities: Sequence[int], overhead: int, attention: int, block: int, more: str = "") -> DataFrame:
    """sized: a batch as parts (rows, lengths, each row's bytes to be cut along with it)."""
    caps = sorted(int(c) for c in capacities)
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be positive")
    most = caps[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        made = 0
        held: list[pd.DataFrame] = []
        count = 0

        def flush() -> pd.DataFrame:
            nonlocal made
            rows = pd.concat(held, ignore_index=True)
            held.clear()
            bins, starts, final = pack_block(rows["piece_length"].to_numpy(), caps, overhead, attention)
            rows["bin_id"] = (task << 40) + made + bins
            rows["bin_capacity"] = final
            rows["bin_start"] = starts
            made += int(bins.max()) + 1
            return rows

        for batch in batches:
            for rows, size, raw in sized(batch):
                parts = np.maximum(1, -(-size // most))
                first = np.cumsum(parts) - parts
                row = np.repeat(np.arange(len(size)), parts)
                piece = np.arange(len(row)) - first[row]
                length = np.minimum(most, size[row] - piece * most)
                cut = pd.DataFrame({"doc_id": rows["doc_id"].array[row], "piece": piece, "piece_start": piece * most, "piece_length": length})
                if raw is not None:
                    cut["ids"] = [raw[r][4 * most * p : 4 * (most * p + n)] for r, p, n in zip(row, piece, length, strict=True)]
                for at in range(0, len(cut), block):
                    held.append(cut.iloc[at : at + block])
                    count += len(held[-1])
                    if count >= block:
                        yield flush()
                        count = 0
        if held and count:
            yield flush()

    return map_frames(docs, run, SCHEMA + more)


def pack_tokens(docs: DataFrame, tokenizer: str, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, block: int = BLOCK // 4) -> DataFrame:
    """Packs the token ids of docs(doc_id, text), each document's with an end mark: one row per piece with its bin and its ids
    (little-endian, 32 bits).  A block holds fewer pieces, as it holds their ids."""
    batch_rows(docs.sparkSession, 500)

    def sized(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, list]]:
        enc = _tokens.encoder(tokenizer, False)
        for a in range(0, len(batch), 250):
            part = batch.iloc[a : a + 250]
            ids, n, _, _ = enc.encode(part["text"].tolist())
            ends = np.cumsum(n)
            mark = np.array([END], "<u4").tobytes()
            yield part, n + 1, [ids[e - k : e].astype("<u4").tobytes() + mark for e, k in zip(ends, n, strict=True)]

    return _packed(docs.select("doc_id", "text"), sized, capacities, overhead, attention, block, ", ids binary")


def pack(docs: DataFrame, length: str, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, block: int = BLOCK) -> DataFrame:
    """Packs docs(doc_id, <length>) and returns one row per piece with its bin."""

    def sized(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, None]]:
        yield batch, batch["length"].fillna(0).clip(lower=0).astype("int64").to_numpy(), None

    return _packed(docs.select("doc_id", F.expr(f"cast({length} as bigint)").alias("length")), sized, capacities, overhead, attention, block)
