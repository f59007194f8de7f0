"""Token-id files compressed by Re-Pair, and their random-access reader.

Documents are dealt by ranges of doc_id; each task encodes its documents in order and closes a shard whenever it
holds ``shard_ids`` ids.  In a shard, Re-Pair counts adjacent pairs exactly, replaces those that occur ``LEAST`` times and more by
nonterminals (all in one round, leftmost first where they overlap) and repeats, until no pair occurs that often.  Rarer pairs would
cost more as rules than they save.

File format: Parquet, one row per shard: task and number (in the order of doc_id), the documents' ids and first places
as int64 (of null ids, which come first, only the number), rules as pairs of uint32 (nonterminal k is 2**17 + k), each rule's expansion length as uint32, the sequence as
uint32 and the place of every 256th symbol as int64, each little-endian, by byte planes (all first bytes, all second, ...) and zlib-compressed.  decode() expands any range of ids by looking up
where it begins.

Every document ends with id 2.  A null text has that id only.  Rows of one doc_id stand next to each other, in the order
of their texts; null doc_ids come first and stay null.  Very long texts are encoded whole; a shard then holds more ids.  An empty table writes no shard.  Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import _tokens
from tracewell.llm._spark import batch_rows, map_frames, partitions, shared_dir

END, FIRST_RULE, LEAST, EVERY = 2, 1 << 17, 5, 256
BINS_LOG2 = 20
SHARD_SCHEMA = "task int, shard int, n_docs long, n_null long, n_ids long, docs binary, starts binary, rules binary, lengths binary, sequence binary, places binary"


def _frequent(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the pairs occur often enough, the number of each one's distinct pair, and these pairs in order of appearance."""
    at = np.arange(len(a))
    if len(a) > 1 << 16:
        # Pairs that occur often enough are in full bins; what else is there is left out by the exact counts.
        key = (a * np.uint32(2654435769) ^ (b * np.uint32(2246822519)) >> np.uint32(7)) >> np.uint32(32 - BINS_LOG2)
        at = np.flatnonzero((np.bincount(key, minlength=1 << BINS_LOG2) >= least)[key])
    code, distinct = pd.factorize((a[at].astype(np.uint64) << np.uint64(32)) | b[at])
    good = np.bincount(code, minlength=len(distinct)) >= least
    keep = good[code]
    return at[keep], (np.cumsum(good) - 1)[code[keep]], distinct[good]


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the rules (pairs of symbols) that expand to ids.

    Symbols stay at their places and are linked to their neighbours.  A round can only add pairs that hold one of its new nonterminals, and
    a pair that was too rare stays so: after the first round, only the places next to replaced pairs, and frequent ones that were not replaced,
    are counted, which is exact."""
    seq, n = ids.astype(np.uint32), len(ids)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    alive, rules, n_rules = np.ones(n + 1, bool), [np.zeros((0, 2), np.uint32)], 0
    at = np.arange(max(0, n - 1))
    while len(at):
        some, code, made = _frequent(seq[at], seq[after[at]], least)
        if not len(made):
            break
        at = at[some]
        # In a run of overlapping pairs every other one is replaced, from the left.
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != after[at[:-1]]
        run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        first = at[take]
        gone = after[first]
        seq[first] = (FIRST_RULE + n_rules + code[take]).astype(np.uint32)
        alive[gone] = False
        after[first] = after[gone]
        before[after[first]] = first
        left = before[first]
        open_ = np.zeros(n, bool)
        open_[at] = open_[first] = open_[left[left >= 0]] = True
        at = np.flatnonzero(open_ & alive[:n])
        at = at[after[at] < n]
        rules.append(np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(made)
    return seq[alive[:n]], np.concatenate(rules)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule expands to.  A rule uses only ids and rules of earlier rounds, so earlier rows."""
    out = np.zeros(len(rules), np.uint32)
    todo = np.arange(len(rules))
    while len(todo):
        side = [np.where(rules[todo, k] < FIRST_RULE, 1, out[np.where(rules[todo, k] < FIRST_RULE, 0, rules[todo, k] - FIRST_RULE)]) for k in (0, 1)]
        ready = (side[0] > 0) & (side[1] > 0)
        out[todo[ready]] = (side[0] + side[1])[ready]
        todo = todo[~ready]
    return out


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """All ids that the symbols stand for."""
    seq = seq.astype(np.uint32)
    while len(seq) and int(seq.max()) >= FIRST_RULE:
        is_rule = seq >= FIRST_RULE
        size = 1 + is_rule.astype(np.int64)
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[first[~is_rule]] = seq[~is_rule]
        pair = rules[seq[is_rule] - FIRST_RULE]
        out[first[is_rule]] = pair[:, 0]
        out[first[is_rule] + 1] = pair[:, 1]
        seq = out
    return seq


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(x.astype(kind)).reshape(-1).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class Shard:
    """Random access to the ids of one row of the files."""

    def __init__(self, rules: bytes, lengths: bytes, sequence: bytes, places: bytes, n_ids: int):
        self.rules, self.lengths = _unpack(rules, "<u4").reshape(-1, 2), _unpack(lengths, "<u4")
        self.seq, self.places, self.n_ids = _unpack(sequence, "<u4"), _unpack(places, "<i8"), n_ids

    def decode(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, expanding only the symbols in between."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.places, start, "right")) - 1
        b = int(np.searchsorted(self.places, stop, "left"))
        ids = expand(self.seq[a * EVERY : b * EVERY], self.rules)
        skip = start - int(self.places[a])
        return ids[skip : skip + stop - start]


def symbol_places(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where every 256th symbol's expansion begins."""
    size = np.ones(len(seq), np.int64)
    rule = seq >= FIRST_RULE
    size[rule] = lengths[seq[rule] - FIRST_RULE]
    return (np.cumsum(size) - size)[::EVERY]


def write(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = 1_000_000) -> None:
    """Encodes docs(doc_id, text) and writes the shards."""
    spark = docs.sparkSession
    batch_rows(spark, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task, made = _tokens.encoder(tokenizer, False), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pd.DataFrame:
            ids, docs_, nulls, counts = (np.concatenate([x[k] for x in held]) for k in range(4))
            held.clear()
            seq, rules = compress(ids)
            lengths = rule_lengths(rules)
            row = {
                "task": task, "shard": made, "n_docs": len(docs_), "n_null": int(nulls.sum()), "n_ids": len(ids), "docs": _pack(docs_, "<i8"), "starts": _pack(np.cumsum(counts) - counts, "<i8"),
                "rules": _pack(rules, "<u4"), "lengths": _pack(lengths, "<u4"), "sequence": _pack(seq, "<u4"), "places": _pack(symbol_places(seq, lengths), "<i8"),
            }
            return pd.DataFrame([row])

        for batch in batches:
            for a in range(0, len(batch), 250):
                part = batch.iloc[a : a + 250]
                ids, n, _, _ = enc.encode(part["text"].tolist())
                out = np.full(len(ids) + len(n), END, np.int32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                held.append((out, part["doc_id"].fillna(0).to_numpy(np.int64), part["doc_id"].isna().to_numpy(), n + 1))
                size += len(out)
                if size >= shard_ids:
                    yield flush()
                    made, size = made + 1, 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_frames(rows, run, SHARD_SCHEMA).write.parquet(path)


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: every document is decoded by its range of ids."""
    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # One narrow row per shard, about a millionth of the ids, is ordered in one task.
    bases = files.select("task", "shard", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples():
                shard = Shard(x.rules, x.lengths, x.sequence, x.places, x.n_ids)
                docs, starts = _unpack(x.docs, "<i8"), _unpack(x.starts, "<i8")
                stops = np.append(starts[1:], x.n_ids)
                crc = np.zeros(len(docs), np.int64)
                # Neighbouring documents are decoded together, a bounded number of ids at a time.
                a = 0
                while a < len(docs):
                    b = max(a + 1, int(np.searchsorted(stops, starts[a] + 200_000, "right")))
                    ids = memoryview(shard.decode(int(starts[a]), int(stops[b - 1])).astype("<u4").tobytes())
                    for k in range(a, b):
                        crc[k] = zlib.crc32(ids[4 * (starts[k] - starts[a]) : 4 * (stops[k] - starts[a])])
                    a = b
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(docs.astype(np.int64), np.arange(len(docs)) < x.n_null), "start": starts + x.base, "n_tokens": stops - starts, "ids_crc32": crc})

    batch_rows(files.sparkSession, 2)
    rows = files.join(bases, ["task", "shard"]).select("rules", "lengths", "sequence", "places", "n_ids", "n_null", "docs", "starts", "base")
    return map_frames(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files of docs to the shared folder and returns what they say of each document."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(spark.read.parquet(path))
