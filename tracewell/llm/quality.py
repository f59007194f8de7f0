"""A byte-level convolutional quality classifier in numpy.

``FILTERS`` learned filters of ``WIDTH`` bytes slide over the whole document.  Each is a table of one weight per place
and byte value, so a convolution is WIDTH table look-ups.  Activations are max-pooled over overlapping chunks of 256 bytes,
every 128 bytes; the pooled chunks give each filter's mean and maximum over the document, and a logistic layer
combines these, and the chunks' own probabilities, into one probability.

Filters are learned with Adam on chunks, gradients reaching only the place that won the pooling; the final layer
by weighted ridge-logistic regression on whole documents.  Both learn from a bounded sample: about ``per_class``
labelled documents of either class, chosen by a hash of doc_id, none over ``most_bytes`` and together at most ``train_bytes``; the sample's
classes are weighted back to their shares among all labels.  Every whole text is scored, of any length.

Null and empty texts are one chunk of padding.  Repeated rows and null ids are scored like any row; of repeated labelled ids the
least text is learned from.  Without labels of both classes
the score is the share of label 1 (0.5 without any).  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._spark import batch_rows, crc_mod, map_frames

WIDTH, FILTERS, HALF = 5, 16, 128
SLICE = 1024  # half-chunks whose activations are held at once


def padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text filled with zeros to whole half-chunks (WIDTH - 1 zeros at least), the first half-chunk of each text (one
    more than texts), and the texts' sizes."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    blocks = (size + WIDTH - 1 + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(blocks)])
    data = np.frombuffer(b"".join(r.ljust(int(b) * HALF, b"\0") for r, b in zip(raw, blocks, strict=True)), np.uint8)
    return data, first, size


class Model:
    def __init__(self, tables: np.ndarray, bias: np.ndarray, chunk: np.ndarray, layer: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.tables, self.bias, self.chunk, self.layer, self.mean, self.scale = tables, bias, chunk, layer, mean, scale

    def halves(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The greatest activation of each filter in each half-chunk."""
        n = int(first[-1])
        out = np.empty((n, FILTERS), np.float32)
        tail = np.zeros(WIDTH - 1, np.uint8)
        last = np.zeros(n, bool)
        last[first[1:] - 1] = True
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            x = data[a * HALF : b * HALF + WIDTH - 1]
            if b == n:
                x = np.concatenate([x, tail])
            m = (b - a) * HALF
            act = self.tables[0].take(x[:m], axis=0)
            for k in range(1, WIDTH):
                act += self.tables[k].take(x[k : k + m], axis=0)
            act = act.reshape(b - a, HALF, FILTERS)
            # Windows that would reach into the next text begin in the padding; they don't count.
            act[last[a:b], HALF - WIDTH + 1 :] = -1e9
            out[a:b] = act.max(axis=1)
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        data, first, _ = padded(texts)
        h = self.halves(data, first)
        pooled = h.copy()
        inner = np.ones(len(h), bool)
        inner[first[1:] - 1] = False
        at = np.flatnonzero(inner)
        pooled[at] = np.maximum(h[at], h[at + 1])
        # The last half-chunk is in the chunk before it, if there is one.
        alone = np.ones(len(h), bool)
        alone[first[1:] - 1] = np.diff(first) == 1
        feat = np.maximum(pooled + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(feat @ self.chunk[:-1] + self.chunk[-1], -30, 30)))
        full = np.column_stack([feat, p, p > 0.5]).astype(np.float64)
        full[~alone] = 0
        begin = first[:-1]
        n = np.add.reduceat(alone.astype(np.float64), begin)[:, None]
        mean = np.add.reduceat(full, begin, axis=0) / n
        most = np.maximum.reduceat(full, begin, axis=0)
        full[~alone] = 1e9
        least = np.minimum.reduceat(full[:, FILTERS : FILTERS + 1], begin, axis=0)
        return np.column_stack([mean, most[:, : FILTERS + 1], least])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        z = ((self.features(texts) - self.mean) / self.scale) @ self.layer[:-1] + self.layer[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Constant:
    """What is known without labels of both classes."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.value)


def fit(texts: list[str], quality: np.ndarray, share: float, epochs: int = 8, chunks: int = 8, seed: int = 11) -> Model | Constant:
    """share: label 1 among all labels."""
    y = np.asarray(quality, np.float64)
    if len(set(y.tolist())) < 2:
        return Constant(share)
    rng = np.random.Generator(np.random.PCG64(seed))
    data, first, _ = padded(texts)
    data = np.concatenate([data, np.zeros(2 * HALF + WIDTH, np.uint8)])
    picks, owner = [], []
    for i in range(len(texts)):
        n = max(1, int(first[i + 1] - first[i]) - 1)
        c = rng.permutation(n)[:chunks]
        picks.append(first[i] + c)
        owner.append(np.full(len(c), i))
    picks, owner = np.concatenate(picks), np.concatenate(owner)
    span = np.where((first[owner + 1] - first[owner]) > 1, 2 * HALF, HALF) - (WIDTH - 1)
    tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    bias, out = np.zeros(FILTERS, np.float32), np.append(rng.normal(0, 0.3, FILTERS), 0.0).astype(np.float32)
    params = [tables, bias, out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step, size = 0, 256
    places = np.arange(2 * HALF - WIDTH + 1)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(picks)), max(1, len(picks) // size)):
            x = data[picks[batch][:, None] * HALF + np.arange(2 * HALF)]
            act = tables[0].take(x[:, : len(places)], axis=0)
            for k in range(1, WIDTH):
                act += tables[k].take(x[:, k : k + len(places)], axis=0)
            act[places[None, :] >= span[batch][:, None]] = -1e9
            won = act.argmax(axis=1)
            feat = np.take_along_axis(act, won[:, None, :], axis=1)[:, 0] + bias
            pos = np.maximum(feat, 0)
            p = 1 / (1 + np.exp(-np.clip(pos @ out[:-1] + out[-1], -30, 30)))
            d = ((p - y[owner[batch]]) * weight[owner[batch]] / len(batch)).astype(np.float32)
            back = np.outer(d, out[:-1]) * (feat > 0)
            g = [np.zeros_like(tables), back.sum(axis=0), np.append(d @ pos, d.sum()).astype(np.float32)]
            f = np.broadcast_to(np.arange(FILTERS), won.shape)
            for k in range(WIDTH):
                np.add.at(g[0][k], (np.take_along_axis(x, won + k, axis=1), f), back)
            step += 1
            for i, p_ in enumerate(params):
                m[i] += 0.1 * (g[i] - m[i])
                v[i] += 0.01 * (g[i] ** 2 - v[i])
                p_ -= 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    model = Model(tables, bias, out, np.zeros(1), np.zeros(1), np.ones(1))
    feats = np.concatenate([model.features(texts[a : a + 64]) for a in range(0, len(texts), 64)])
    model.mean, model.scale = feats.mean(axis=0), feats.std(axis=0) + 1e-3
    x = np.column_stack([(feats - model.mean) / model.scale, np.ones(len(feats))])
    prior = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 2.0), 1e-6)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (prior * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(h, x.T @ (prior * (p - y)) + ridge * w)
    model.layer = w
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_bytes: int = 256_000, train_bytes: int = 64_000_000) -> Model | Constant:
    """Learns from labelled documents whose crc32 remainder is not 0."""
    known = labels.where((crc_mod("doc_id", 5) != 0) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    if len(n) < 2:
        return Constant(n.get(1, 0) / total if total else 0.5)
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(2)), F.lit(1_000_000_000))
    limit = F.when(F.col("quality") == 1, int(1e9 * min(1, per_class / n[1]))).otherwise(int(1e9 * min(1, per_class / n[0])))
    # About 2 * per_class rows at any input size, so the side that is broadcast is bounded.
    chosen = known.where(drawn < limit).orderBy(drawn).limit(3 * per_class)
    taught = docs.where((crc_mod("doc_id", 5) != 0) & (F.octet_length("text") <= most_bytes)).select("doc_id", "text")
    sizes = taught.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max("size").alias("size"), F.max(drawn).alias("drawn"))
    # 3 * per_class narrow rows at most; each class may fill half of the bytes.
    kept, filled = [], {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: r["drawn"]):
        if filled[r["quality"]] + r["size"] <= train_bytes // 2:
            filled[r["quality"]] += r["size"]
            kept.append((r["doc_id"], r["quality"]))
    ids = docs.sparkSession.createDataFrame(kept, "doc_id long, quality int")
    rows = taught.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["text"], r["quality"]) for r in rows.toLocalIterator())
    if len({r[2] for r in got}) < 2:
        return Constant(n[1] / total)
    return fit([r[1] for r in got], np.array([r[2] for r in got]), n[1] / total)


def score(docs: DataFrame, model: Model | Constant, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    batch_rows(docs.sparkSession, 1000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                p = model.scores(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": p, "predicted": (p >= threshold).astype(int)})

    rows = docs.select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return map_frames(rows, run, "doc_id long, held_out boolean, score double, predicted int")
