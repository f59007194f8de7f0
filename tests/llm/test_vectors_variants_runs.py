"""Vector packing, spelling variants and periodic runs against brute force, by hand, and on odd tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import _tokens, periodic, queries, spelling, vector_packing
from tracewell.llm._spark import tokenizer_file

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, word string, start long, ids string, runs string, key string"


def table(spark, texts):
    rows = [(i if i >= 0 else None, t, 1, "w", 2, "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    texts = [None, "", " \n\t", "one", "a a a a a a", "x y " * 40, "z" * 5000, "Ünï — ’s don't 12  x"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    texts += [texts[-1], " ".join(vocab * 200)]
    rows = list(enumerate(texts))
    return [*rows, (2**53 + 1, "large ids stay whole"), (3, "a repeated id"), (-1, "no id at all")]


# Vector packing


def check_sequences(rows, limits, padded=True):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r["loss_tokens"] for r in pieces) <= limits.loss
        assert at == limits.tokens or at & (at - 1) == 0  # nothing is padded
    return by


@pytest.fixture(scope="module")
def byte_tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


@pytest.mark.parametrize("limits", [(2048, 64, 2048), (256, 3, 256), (64, 64, 40)])
def test_documents_are_packed_whole(spark, byte_tokenizer, limits):
    limits = vector_packing.Limits(*limits)
    texts = odd_texts()
    rows = vector_packing.pack_documents(table(spark, texts).repartition(3), tokenizer_file("byte_bpe_50k.json"), limits).collect()
    check_sequences(rows, limits)
    got = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["loss_tokens"] == r["length"] - (r["start"] == 0)
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    want = Counter()
    for i, t in texts:
        ids = [*byte_tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[(i if i >= 0 else None, len(ids), struct.pack(f"<{len(ids)}I", *ids))] += 1
    for (doc, n, raw), k in want.items():
        pieces = sorted(got[(doc, n)])
        assert b"".join(p for _, p in pieces) == raw * k if k == 1 else True
        assert sum(len(p) for _, p in pieces) == 4 * n * k


def test_examples_have_marks_of_their_own(spark):
    rng = random.Random(2)
    rows = [(None, None, None), (1, [], None), (2, [7, 8, 9], None), (3, [1, 2, 3], [True])]
    for i in range(4, 300):
        n = rng.randint(1, 400)
        prompt = rng.randint(0, n)
        rows.append((i, list(range(n)), [False] * prompt + [True] * (n - prompt)))
    limits = vector_packing.Limits(512, 5, 200)
    got = vector_packing.pack_examples(spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>").repartition(2), limits).collect()
    check_sequences(got, limits)
    for i, ids, loss in rows:
        pieces = sorted((r["start"], bytes(r["ids"]), r["loss_tokens"]) for r in got if r["doc_id"] == i)
        assert b"".join(p[1] for p in pieces) == np.array(ids or [], "<u4").tobytes()
        assert sum(p[2] for p in pieces) == sum(loss or [])
    # All three limits close sequences.
    by = check_sequences(got, limits)
    assert any(len(p) == 5 for p in by.values()) and any(sum(r["loss_tokens"] for r in p) == 200 for p in by.values()) and any(sum(r["length"] for r in p) == 512 for p in by.values())


def test_dot_product_by_hand():
    """All that waits asks mostly for loss, of which the second has most: it goes first, then what still fits."""
    packer = vector_packing.Packer(vector_packing.Limits(100, 10, 20))
    marks = {"a": (60, 2), "b": (40, 18), "c": (30, 18), "d": (1, 0)}
    for name, (n, loss) in marks.items():
        before = np.concatenate([[0], np.cumsum([0] * (n - loss) + [1] * loss)])
        assert not list(packer.add(vector_packing.Example(name, np.arange(n), before)))
    size, most = np.array([(n, 1, k) for n, k in marks.values()]), np.array([100, 10, 20])
    demand = size / most
    weight = demand.sum(axis=0) / demand.sum()
    first = "abcd"[int((demand @ weight).argmax())]
    assert first == "b"
    pieces = [(x.doc_id, a, b) for x, a, b in packer.sequence()]
    assert pieces[0] == ("b", 0, 40) and pieces[1] == ("a", 0, 60)
    assert sorted(x.doc_id for x in packer.of) == ["c", "d"]


def test_byte_pieces_give_the_library_ids(byte_tokenizer):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "word", "Éa", "don't", "'s", " 're", "12", "x1", "!!", "--", "日本", " ", " ", "\x1c", "\x85", "é", "<|endoftext|>", "<|", "​", "ª", "×", "٣", "\r\n", "　", "😀", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [t for c in range(0, 0x3100) if not 0xD800 <= c < 0xE000 for t in (f"a {chr(c)} b", f"a  {chr(c)}", f"{chr(c)}  b", f"a{chr(c)}b")]
    enc = _tokens.encoder(tokenizer_file("byte_bpe_50k.json"), False)
    assert isinstance(enc, _tokens.BytePieceEncoder)
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        ids, n, _, _ = enc.encode(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [byte_tokenizer.encode(t, add_special_tokens=False).ids for t in part]


# Spelling variants


def plain_counts(rows, gaps=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % gaps == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, letters=6, least=5, ratio=5):
    n = {w: k for w, k in counts.items() if len(w) >= letters and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelled_rows(seed=4):
    rng = random.Random(seed)
    letters = "abcdeé÷Éßz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 5, 30, 200])
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words += [v] * rng.choice([1, 4, 5, 6, 25])
    words += ["chainof"] * 2000 + ["chainoff"] * 250 + ["chainoffz"] * 30  # forms of forms
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    texts = [" ".join(words[a : a + 97]) for a in range(0, len(words), 97)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0]), (7, texts[0]), (2**53 + 1, texts[1]), (9, None), (10, ""), (11, "x1 ÀÉ" + "q" * 3000 + " " + "ab" * 40 + "," + "ab" * 40)]


def test_variants_equal_brute_force(spark):
    rows = spelled_rows()
    want = plain_variants(plain_counts(rows, 7))
    assert any(w == "chainoffz" and f == "chainoff" and r == "chainof" for w, f, r, *_ in want)
    docs = table(spark, [(-1 if i is None else i, t) for i, t in rows]).repartition(3)
    got = spelling.variants(docs, gaps=7).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_variants_of_nothing(spark):
    assert spelling.variants(table(spark, []).limit(0)).count() == 0
    assert spelling.variants(table(spark, [(1, None), (2, ""), (3, "12 ...")])).count() == 0


def test_run_hashes_are_the_library_hashes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    s = rng.integers(0, 2000, 200)
    e = s + rng.integers(0, 150, 200)
    before = rng.integers(0, 2**32, 200, dtype=np.uint64).astype(np.uint32)
    got = spelling.crc_of_runs(data, s, e, before)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(s, e, before, strict=True)]


def test_one_edit_leaves_a_band(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüÿ÷"
    pairs = []
    for _ in range(300):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        k = rng.randrange(len(w))
        pairs.append((w, rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a string, b string").select("a", *[spelling.parity_band(F.col(c), k).alias(f"{c}{k}") for c in "ab" for k in range(3)])
    for r in df.collect():
        assert any(r[f"a{k}"] == r[f"b{k}"] for k in range(3))
        place = lambda ch: ord(ch) - (192 - 26 if ord(ch) >= 192 else 97)
        for k in range(3):
            mask = 0
            for ch in r["a"]:
                mask ^= (1 << place(ch) // 3) if place(ch) % 3 == k else 0
            assert r[f"a{k}"] == mask


# Periodic runs


def plain_runs(words, least=6, times=4):
    n, out = len(words), []

    def smallest(a, b):
        return next(q for q in range(1, b - a + 1) if all(words[i] == words[i + q] for i in range(a, b - q)))

    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            b = i + q
            if b - a >= max(least, times * q) and smallest(a, b) == q:
                out.append((a, b - a, q))
    return sorted(out)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(700):
        k = rng.randint(1, 4)
        words = []
        while len(words) < rng.randint(0, 130):
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            words += unit * rng.randint(1, 7)
        assert [tuple(r) for r in periodic.runs(periodic.word_ids([bytes([w]) for w in words]))] == plain_runs(words)


def test_long_lags_equal_brute_force():
    rng = random.Random(9)
    for unit in (40, 75):
        block = [rng.randrange(1000) for _ in range(unit)]
        words = [rng.randrange(1000) for _ in range(100)] + block * 5 + block[: unit // 2] + [rng.randrange(1000) for _ in range(90)]
        words += [rng.randrange(3) for _ in range(60)] + block * 4
        assert [tuple(r) for r in periodic.runs(np.array(words))] == plain_runs(words)


def test_detected_runs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts()
    texts += [(1000 + i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(5, 200)))) for i in range(150)]
    texts += [(2000, "u\x0bv\x0cw x " * 30), (2001, "a b c d " * 9)]
    got = periodic.summary(periodic.detect(table(spark, texts).repartition(3), alter=True)).collect()
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = Counter(plain_row(i if i >= 0 else None, t) for i, t in texts)
    assert Counter(tuple(r[c] for c in columns) for r in got) == want
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in texts)


def test_runs_of_nothing(spark):
    assert periodic.summary(periodic.detect(table(spark, []).limit(0))).count() == 0


def test_queries_equal_brute_force(spark, byte_tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.QUERIES["op12_parity_bands"](spark, SF).collect()}
    assert got == plain_variants(plain_counts(docs))
    rows = queries.QUERIES["op11_vector_packing"](spark, SF).collect()
    check_sequences(rows, vector_packing.Limits())
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(pieces) == {i for i, _ in docs}
    for i, t in docs:
        ids = [*byte_tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, n, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))
            at += n
        assert at == len(ids)


def test_long_documents_have_the_runs_of_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_bit_lags"](spark, SF).collect()}
    for i, t in docs:
        want = plain_row(i, t)
        assert got[i] == want
