"""Vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens at the same time.

A sequence is filled by the dot-product heuristic: of the pieces that fit, the one goes in whose demand (tokens, one segment, loss-bearing
tokens), each by its limit and weighted by how much of that limit all waiting pieces ask for, has the greatest product with the room left.
If none fits whole while room is left, one is cut to fill it.  A sequence that a limit other than tokens ends, or with which the input ends,
gives back what is over a power of two; so every sequence is of full length or of a power of two, and nothing is padded.

Each task packs its own partition and holds at most ``POOL`` waiting pieces, each shorter than a sequence; longer texts are cut into
full sequences as they come.  No shuffle: a lost task packs the same rows in the same order again, so sequence ids, made of the task's
partition and a counter, do not change.

A token of a document bears loss unless it is the document's first, which nothing predicts; examples bring marks of their own (a prompt bears
none).  Null texts are empty: they have only the end id.  An example without ids gives no piece.  Very long texts are encoded whole, then cut.
Repeated rows are packed one by one; a null doc_id is carried along.  Of equal pieces the one that has waited longest goes first.  An empty
table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracewell.llm import _tokens
from tracewell.llm._spark import batch_rows, map_frames

END, POOL, PART = 1, 1024, 500


class Limits(NamedTuple):
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


SCHEMA = "doc_id long, start long, length long, loss_tokens long, doc_tokens long, sequence_id long, offset long, ids binary"


class Example(NamedTuple):
    doc_id: object
    ids: np.ndarray
    #: How many loss-bearing tokens come before each place; None: all but the first bear loss.
    before: np.ndarray | None = None

    def loss(self, start: int, end: int) -> int:
        if self.before is None:
            return max(0, end - max(1, start))
        return int(self.before[end] - self.before[start])

    def longest(self, start: int, tokens: int, loss: int) -> int:
        """How many of the tokens from start on fit, of both kinds."""
        end = min(len(self.ids), start + tokens)
        if self.loss(start, end) > loss:
            end = max(1, start) + loss if self.before is None else int(np.searchsorted(self.before, self.before[start] + loss, "right")) - 1
        return min(end, len(self.ids)) - start


class Packer:
    """The pieces that wait, in the order of their coming, and the sequences made of them."""

    def __init__(self, limits: Limits):
        if min(limits) < 1:
            raise ValueError("limits must be positive")
        self.limits = limits
        self.of: list[Example] = []
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros((0, 3), np.int64)  # tokens, segments, loss-bearing tokens

    def add(self, example: Example) -> Iterator[list[tuple[Example, int, int]]]:
        """Takes an example up; full sequences of a long one alone come out at once."""
        at, n = 0, len(example.ids)
        while n - at >= self.limits.tokens and example.longest(at, self.limits.tokens, self.limits.loss) == self.limits.tokens:
            yield [(example, at, at + self.limits.tokens)]
            at += self.limits.tokens
        if at < n:
            self._wait([(example, at, n)])

    def _wait(self, pieces: list[tuple[Example, int, int]]) -> None:
        self.of += [p[0] for p in pieces]
        self.start = np.concatenate([self.start, np.array([a for _, a, _ in pieces], np.int64)])
        self.size = np.concatenate([self.size, np.array([(b - a, 1, x.loss(a, b)) for x, a, b in pieces], np.int64).reshape(-1, 3)])

    def sequence(self) -> list[tuple[Example, int, int]]:
        """Fills one sequence from what waits."""
        most = np.array(self.limits, np.float64)
        # Both the demand and the room count by their limits; a limit weighs by how much of it all pieces ask for.
        demand = self.size / most
        weight = demand.sum(axis=0) / max(1e-12, demand.sum())
        room = np.array(self.limits, np.int64)
        waits = np.ones(len(self.of), bool)
        out: list[tuple[Example, int, int]] = []
        while room[0] and room[1] and waits.any():
            value = np.where(waits & (self.size <= room).all(axis=1), demand @ (weight * room / most), -1.0)
            k = int(value.argmax())
            cut = 0
            if value[k] < 0:  # none fits whole: cut the one with the greatest product
                k = int(np.where(waits, demand @ (weight * room / most), -1.0).argmax())
                cut = self.of[k].longest(int(self.start[k]), int(room[0]), int(room[2]))
                if cut <= 0:
                    break
            x, a = self.of[k], int(self.start[k])
            n = cut or int(self.size[k, 0])
            out.append((x, a, a + n))
            room -= (n, 1, x.loss(a, a + n))
            if cut:
                self.start[k] += n
                self.size[k] = (self.size[k, 0] - n, 1, x.loss(a + n, a + int(self.size[k, 0])))
                break  # the room is filled, in tokens or in loss
            waits[k] = False
        self.of = [x for x, w in zip(self.of, waits.tolist(), strict=True) if w]
        self.start, self.size = self.start[waits], self.size[waits]
        length = self.limits.tokens - int(room[0])
        if length < self.limits.tokens:
            out = self._trimmed(out, length)
        return out

    def _trimmed(self, pieces: list[tuple[Example, int, int]], length: int) -> list[tuple[Example, int, int]]:
        """The pieces, cut to the greatest power of two; what is over waits again.  The longest pieces give first, so few are cut."""
        over, kept, back = length - (1 << (length.bit_length() - 1)), [], []
        for x, a, b in sorted(pieces, key=lambda p: p[1] - p[2]):
            gone = min(over, b - a)
            over -= gone
            if gone < b - a:
                kept.append((x, a, b - gone))
            if gone:
                back.append((x, b - gone, b))
        self._wait(back)
        return kept


def _packed(rows: DataFrame, examples: Callable[[pd.DataFrame], Iterator[Example]], limits: Limits) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, task, made = Packer(limits), TaskContext.get().partitionId(), 0

        def frame(sequences: list[list[tuple[Example, int, int]]]) -> pd.DataFrame:
            nonlocal made
            out = []
            for pieces in sequences:
                offset = 0
                for x, a, b in pieces:
                    out.append((x.doc_id, a, b - a, x.loss(a, b), len(x.ids), (task << 40) + made, offset, x.ids[a:b].astype("<u4").tobytes()))
                    offset += b - a
                made += 1
            return pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

        done: list[list[tuple[Example, int, int]]] = []
        for batch in batches:
            for example in examples(batch):
                done += packer.add(example)
                if len(packer.of) >= POOL:
                    while len(packer.of) > POOL // 2:
                        done.append(packer.sequence())
                if len(done) >= POOL:
                    yield frame(done)
                    done = []
        while packer.of:
            done.append(packer.sequence())
        if done:
            yield frame(done)

    return map_frames(rows, run, SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end: int = END) -> DataFrame:
    """Packs the token ids of docs(doc_id, text), each document's with the end id: one row per piece with its sequence and its ids
    (little-endian, 32 bits)."""
    batch_rows(docs.sparkSession, PART)

    def examples(batch: pd.DataFrame) -> Iterator[Example]:
        enc = _tokens.encoder(tokenizer, False)
        for at in range(0, len(batch), PART):
            part = batch.iloc[at : at + PART]
            ids, n, _, _ = enc.encode(part["text"].tolist())
            for doc_id, own in zip(part["doc_id"], np.split(ids, np.cumsum(n)[:-1]), strict=True):
                yield Example(doc_id, np.append(own, np.int32(end)))

    return _packed(docs.select("doc_id", "text"), examples, Limits(*limits))


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Packs instruction data, examples(doc_id, ids array<int>, loss array<boolean>): the answers' tokens bear loss.  Null ids are none, a
    null or short array of marks is taken to go on with false."""
    batch_rows(examples.sparkSession, PART)

    def taken(batch: pd.DataFrame) -> Iterator[Example]:
        for doc_id, ids, loss in zip(batch["doc_id"], batch["ids"], batch["loss"], strict=True):
            own = np.zeros(0, np.int32) if ids is None else np.asarray(ids, np.int32)
            marks = np.zeros(len(own), np.int64)
            if loss is not None:
                given = np.array([bool(x) for x in loss[: len(own)]], np.int64)
                marks[: len(given)] = given
            yield Example(doc_id, own, np.concatenate([[0], np.cumsum(marks)]))

    return _packed(examples.select("doc_id", "ids", "loss"), taken, Limits(*limits))
