"""Near-duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1. Every text becomes the set of its word n-grams (64-bit hashes); equal sets collapse to the least doc_id.
2. One-permutation MinHash (empty bins filled from others, in an order that is fixed per bin) gives each of ``TREES``
   trees a label of ``DEPTH`` values.  Each tree is one sorted order of (label, id), dealt to tasks by range, so a
   large group of copies spreads over tasks.  Neighbours whose labels share at least ``depth`` values are candidates (see least_depth).
3. Depth adapts to the region: a run of at most ``SMALL`` such rows gives all its pairs; in a denser one each row pairs
   with its neighbour in the order of the whole label, which has the longest common prefix.  Tasks stream their rows; runs that
   reach the end of a range go on in a second pass over the outer rows of each task, dealt by run.
4. Every document's likeliest candidate (that of most trees) is confirmed on full sets first; of the others only those between
   the components that this gives (large-star / small-star).
5. What a dense region left out is found exactly: its sets are joined on their rarest shingles (a set and another with
   similarity s share one of the first n - ceil(s n) + 1 in any order, and enough shingles must follow it in both), and only
   where a shingle still connects different components.  These pairs are confirmed and joined as well.

Sets are made from the texts where they are needed; every table that a step leaves is deleted when the next one has been written.

The least depth is the greatest at which a pair just similar enough shares a prefix in one of the 16 trees with
probability 1 - 2e-5 at least: 4 for 0.85, 3 for 0.8.

Null or wordless texts have no shingles and no links.  Rows with the same doc_id are one document: a link of one is a
link of all.  A null doc_id is given back unlinked.  Very long texts are read whole.  Ties (equal likelihood) go to the lesser ids and
don't change the components.  Other columns are not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import _text
from tracewell.llm._spark import Scratch, batch_rows, map_frames, partitions

TREES, DEPTH, SMALL, MISSED = 16, 6, 5, 2e-5
BINS = TREES * DEPTH
ROWS_PER_TASK, HELD, FEW = 500_000, 100_000, 10_000
SLOTS = 1 << 18
_EDGES = (np.arange(1, BINS, dtype=np.float64) * (2.0**64 / BINS)).astype(np.uint64)
_BORROW = np.argsort(np.random.Generator(np.random.PCG64(7)).random((BINS, BINS)), axis=1)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = _text.words(texts)
    grams = _text.windows(h, words)
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(_text.windows(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def labels(s: np.ndarray) -> bytes:
    """The labels of all trees: the least hash of each bin, big-endian, so that bytes sort as the values do."""
    at = np.zeros(BINS + 1, np.int64)
    at[1:BINS] = np.searchsorted(s, _EDGES)
    at[BINS] = len(s)
    full = at[1:] > at[:-1]
    if not full.all():
        donor = _BORROW[np.arange(BINS), full[_BORROW].argmax(axis=1)]
        donor[full] = np.flatnonzero(full)
        v = _text.mix(s[at[donor]] + donor.astype(np.uint64))
    else:
        v = _text.mix(s[at[:-1]] + np.arange(BINS, dtype=np.uint64))
    return (v >> np.uint64(32)).astype(">u4").tobytes()


def bitmap(s: np.ndarray) -> list[int]:
    """1,024 bits, of which each hash sets one: two sets differ in at least as many hashes as their bitmaps do in bits."""
    bits = np.zeros(1024, bool)
    bits[((s >> np.uint64(20)) & np.uint64(1023)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.iloc[at : at + 200]
            yield part, shingle_sets(part["text"].tolist(), words)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in _sets(batches, words):
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].array,
                    "n_shingles": [len(s) for s in sets],
                    "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "labels": [labels(s) if len(s) else None for s in sets],
                    "bits": [bitmap(s) if len(s) else None for s in sets],
                }
            )

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, key binary, labels binary, bits array<long>")


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values rows of two label matrices share."""
    return np.where(a == b, 1, 0).cumprod(axis=1).sum(axis=1)


def least_depth(percent: int) -> int:
    return max([1, *(d for d in range(1, DEPTH) if (1 - (percent / 100) ** d) ** TREES <= MISSED)])


def _runs(tree: np.ndarray, label: np.ndarray, depth: int) -> np.ndarray:
    """Where runs of rows with a common prefix of that depth begin."""
    n = len(tree)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = (tree[1:] != tree[:-1]) | (_prefix(label[1:, :depth], label[:-1, :depth]) < depth)
    return np.flatnonzero(new)


class Runs:
    """Runs of a sorted stream of rows (tree, label, id, size of the run as far as known).  It holds the last SMALL rows of the
    open run, and how many went before them."""

    def __init__(self, depth: int):
        self.depth, self.past, self.done = depth, 0, False
        self.tree, self.label, self.rep, self.size = np.zeros(0, np.int64), np.zeros((0, DEPTH), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.head: list[tuple] = []  # the outer rows of the first run, and its size
        self.head_size, self.seen = 0, 0

    def feed(self, tree: np.ndarray, label: np.ndarray, rep: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidate pairs (x, y) that the new rows are part of, and the ids in dense runs."""
        old = len(self.rep)
        tree, label = np.concatenate([self.tree, tree]), np.concatenate([self.label, label])
        rep, size = np.concatenate([self.rep, rep]), np.concatenate([self.size, size])
        first = _runs(tree, label, self.depth)
        n = np.diff(np.append(first, len(tree)))
        of = np.repeat(np.arange(len(first)), n)
        n[0] += self.past
        dense = (n > SMALL) | (np.maximum.reduceat(size, first) > SMALL)
        xs, ys = [], []
        for d in range(1, SMALL):
            i = np.arange(max(0, old - d), len(tree) - d)
            i = i[(of[i] == of[i + d]) & (~dense[of[i]] | (d == 1)) & (rep[i] != rep[i + d])]
            xs.append(rep[i])
            ys.append(rep[i + d])
        if not self.done:
            self.head_size = int(n[0])
            for k in range(old, old + min(len(tree) - old, SMALL - len(self.head))):
                if of[k] == 0:
                    self.head.append((int(tree[k]), label[k].tobytes(), int(rep[k])))
            self.done = len(first) > 1
        self.seen += len(first) - 1
        keep = max(int(first[-1]), len(tree) - SMALL)
        self.past = int(n[-1]) - (len(tree) - keep)
        self.tree, self.label, self.rep, self.size = tree[keep:], label[keep:], rep[keep:], np.maximum(size[keep:], size[first[-1] :].max())
        return np.concatenate(xs), np.concatenate(ys), np.unique(rep[dense[of]])

    def edge(self) -> list[tuple]:
        """The outer rows of the first and of the last run, with the runs' sizes."""
        out = [(*x, self.head_size) for x in self.head]
        last = self.past + len(self.rep)
        if self.seen or last > SMALL:
            out += [(int(t), x.tobytes(), int(r), last) for t, x, r in zip(self.tree, self.label, self.rep, strict=True)]
        return out


def forest(reps: DataFrame, tasks: int, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) with the number of neighbourhoods that they share, and the ids in dense regions, of reps(rep, labels)."""
    trees = reps.select("rep", F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(labels, t * {4 * DEPTH} + 1, {4 * DEPTH}))")).alias("tree", "label"))
    ordered = trees.withColumn("run", F.lit(1).cast("long")).repartitionByRange(tasks, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    schema = "kind int, a long, b long, tree int, label binary, run long"

    def passing(outer: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            runs = Runs(depth)
            for x in batches:
                if not len(x):
                    continue
                label = np.frombuffer(b"".join(x["label"]), ">u4").reshape(-1, DEPTH)
                a, b, hot = runs.feed(x["tree"].to_numpy(np.int64), label, x["rep"].to_numpy(np.int64), x["run"].to_numpy(np.int64))
                yield pd.DataFrame({"kind": np.repeat([0, 1], [len(a), len(hot)]), "a": np.concatenate([np.minimum(a, b), hot]), "b": np.concatenate([np.maximum(a, b), hot]), "tree": 0, "label": None, "run": 0})
            if outer and len(runs.rep):
                tree, label, rep, size = zip(*runs.edge(), strict=True)
                yield pd.DataFrame({"kind": 2, "a": rep, "b": rep, "tree": tree, "label": label, "run": size})

        return run

    found = scratch.keep(map_frames(ordered, passing(True), schema))
    # At most 2 * SMALL rows of each task go on, dealt by run.
    edges = found.where("kind = 2").select(F.col("a").alias("rep"), "tree", "label", "run").repartition(partitions(reps.sparkSession), "tree", F.expr(f"substring(label, 1, {4 * depth})")).sortWithinPartitions("tree", "label", "rep")
    every = found.where("kind < 2").unionByName(map_frames(edges, passing(False), schema)).groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("votes"))
    every = scratch.keep(every, found)
    return every.where("kind = 0").select("a", "b", "votes"), every.where("kind = 1").select(F.col("a").alias("doc_id"))


def bits_apart(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"


def near_bits(a: str, b: str, sizes: str, percent: int) -> str:
    """Sets alike enough differ in at most (100 - percent) / (100 + percent) of their sizes' sum, and their bitmaps in no more bits."""
    return f"{bits_apart(a, b)} * {100 + percent} <= {100 - percent} * ({sizes})"


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sizes and bitmaps don't rule them out, and how many bits their bitmaps are apart."""
    few = [reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"]
    fits = F.expr(f"least(na, nb) * 100 >= greatest(na, nb) * {percent} AND {near_bits('bitsa', 'bitsb', 'na + nb', percent)}")
    return pairs.join(few[0], "a").join(few[1], "b").where(fits).select(*pairs.columns, F.expr(bits_apart("bitsa", "bitsb")).alias("apart"))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets have 100 * intersection >= percent * union."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                sets = shingle_sets([*part["ta"], *part["tb"]], words)
                keep = np.zeros(len(part), bool)
                for i, (x, y) in enumerate(zip(sets[: len(part)], sets[len(part) :], strict=True)):
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = n > 0 and 100 * n >= percent * (len(x) + len(y) - n)
                yield part.loc[keep, ["a", "b"]]

    return map_frames(pairs.select("a", "b").join(left, "a").join(right, "b"), run, "a long, b long").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its least reachable id) of every node of links(a, b) other than the component itself."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        def stars() -> pd.DataFrame:
            out = [(x, root(x)) for x in list(parent)]
            parent.clear()
            return pd.DataFrame([x for x in out if x[0] != x[1]], columns=["u", "v"])

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            if len(parent) > HELD:  # a task's memory is bounded; what it holds at once is joined at once
                yield stars()
        yield stars()

    edges = scratch.keep(map_frames(links, local, "u long, v long").distinct())
    before = _signature(edges)
    if 0 < before[0] <= FEW:
        # So few links, whatever the size of the input, are joined at once in one task.
        edges = scratch.keep(map_frames(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1), local, "u long, v long"), edges)
        before = (0,)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # After the large star a node has few lesser neighbours, so a window does for the small one.
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        edges = scratch.keep(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), edges)
        after = _signature(edges)
        if after == before:
            break
        before = after
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    scratch.paths[id(named)] = scratch.paths.pop(id(edges))
    return named


def between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of different components, with these as ca < cb."""
    for x in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")), x, "left").withColumn(f"_{x}", F.coalesce(f"_{x}", x))
    return pairs.where("_a <> _b").withColumn("ca", F.least("_a", "_b")).withColumn("cb", F.greatest("_a", "_b")).drop("_a", "_b")


def prefixes_of(docs: DataFrame, hot: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, component, n, place, token: the rarest shingles of the hot documents."""
    ids = hot.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    dense = docs.join(ids, "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for _, sets in _sets(batches, words):
            total += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    # A table of SLOTS counts stands for the shingles' frequencies: any order of shingles is exact, a rare-first one cheap.
    rows = map_frames(dense.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    rarity = np.zeros(SLOTS, np.int64)
    rarity[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in _sets(batches, words):
            kept = []
            for s in sets:
                keep = len(s) + (-percent * len(s)) // 100 + 1 if len(s) else 0
                kept.append(s[np.lexsort((s, rarity[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))[:keep]].view(np.int64))
            size = np.array([len(x) for x in kept])
            of = np.repeat(np.arange(len(part)), size)
            n = np.array([len(s) for s in sets])
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[of], "component": part["component"].to_numpy()[of], "n": n[of], "place": _text.flat_ranges(np.zeros(len(size), np.int64), size), "token": np.concatenate(kept)})

    return map_frames(dense, prefixes, "doc_id long, component long, n int, place int, token long")


def rest_of_dense(docs: DataFrame, reps: DataFrame, hot: DataFrame, found: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of hot documents in different components (ca, cb) that share one of their rarest shingles, and how many
    bits their bitmaps are apart."""
    rows = scratch.keep(prefixes_of(docs, hot, found, words, percent))
    mixed = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    rows = scratch.keep(rows.join(mixed, "token", "left_semi"), rows)
    wide = rows.join(reps.select(F.col("rep").alias("doc_id"), "bits"), "doc_id")
    x, y = wide.alias("x"), wide.alias("y")
    # A link has at least percent (x.n + y.n) / (100 + percent) shingles in common, all at or behind the first common one.
    apart = F.expr(
        f"x.component <> y.component AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) "
        f"AND least(x.n - x.place, y.n - y.place) * {100 + percent} >= {percent} * (x.n + y.n) "
        f"AND {near_bits('x.bits', 'y.bits', 'x.n + y.n', percent)}"
    )
    near = x.join(y, (F.col("x.token") == F.col("y.token")) & apart).select(
        F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.least("x.component", "y.component").alias("ca"), F.greatest("x.component", "y.component").alias("cb"), F.expr(bits_apart("x.bits", "y.bits")).alias("apart")
    )
    return near


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    scratch = Scratch(spark, "near-duplicates")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = scratch.keep(sketch(docs, words))
    reps = sketches.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("labels").alias("labels"), F.first("bits").alias("bits"))
    reps = scratch.keep(reps)
    tasks = max(partitions(spark), -(-reps.count() * TREES // ROWS_PER_TASK))
    pairs, hot = forest(reps.select("rep", "labels"), tasks, least_depth(percent), scratch)

    # Every document's likeliest neighbour comes first: this joins large groups with one pair for each of their documents.
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes"))
    best = both.groupBy("a").agg(F.min_by("b", F.struct(-F.col("votes"), F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    best = scratch.keep(best)
    found = components(confirmed(best, docs, words, percent), scratch)

    def looked_at(rest: DataFrame, found: DataFrame) -> DataFrame:
        """The components once the pairs rest(a, b, ca, cb, apart) have been confirmed.  Of the pairs between two components the
        likeliest comes first; the links that these give leave few others open."""
        rest = scratch.keep(rest)
        likeliest = scratch.keep(rest.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b", "ca", "cb"))
        if likeliest.isEmpty():
            return found
        across = lambda pairs: pairs.join(confirmed(pairs, docs, words, percent), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        some = scratch.keep(across(likeliest))
        up = components(some, scratch)
        left = between(rest.join(likeliest, ["a", "b"], "left_anti").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("ca").alias("a"), F.col("cb").alias("b")), up)
        left = scratch.keep(left.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("a").alias("ca"), F.col("b").alias("cb")), likeliest, rest)
        if not left.isEmpty():
            up = components(some.unionByName(across(left)), scratch)
        lifted = found.join(up.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return scratch.keep(lifted.unionByName(up), found, some, left)

    # The forest's other pairs join what they can before the dense regions' shingles are joined across components.
    found = looked_at(likely(between(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), found), reps, percent), found)
    if not hot.isEmpty():
        found = looked_at(rest_of_dense(docs, reps, hot, found, words, percent, scratch).distinct(), found)

    known = sketches.where("key IS NOT NULL AND doc_id IS NOT NULL")
    of_rep = known.join(reps.select("key", "rep"), "key").select("doc_id", "rep")
    if not known.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").isEmpty():
        # Rows of one doc_id are one document: their sets' representatives are linked through it.
        same = of_rep.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(same), scratch)
        of_rep = known.select("doc_id", F.col("doc_id").alias("rep"))
    named = of_rep.distinct().join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "doc_id")
    out = sketches.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = scratch.keep(out)
    scratch.keep_only(out)
    return out
