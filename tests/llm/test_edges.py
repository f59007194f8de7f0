"""Large and null ids, clashing columns, very long and very repetitive inputs, and brute-force twins of the inner steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import _text, _tokens, decontaminate, fingerprints, html_main, langid, neardup, packing, quality, queries, repair_ids, sharding, token_counts

BIG = 2**53 + 1
WORDS = [f"word{i}" for i in range(400)]


def text(seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def odd(spark):
    """Ids that doubles can't hold, next to null ids, in one partition, with columns named like the operators' own."""
    rows = [(BIG, text(1)), (None, text(2)), (BIG + 2, text(3)), (None, None), (BIG + 4, text(1)), (BIG + 6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for name in ("key", "label", "rep", "labels", "n", "length", "piece", "shard", "task", "slot", "lang", "held_out", "score", "set", "bits", "component"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def ids():
    return {BIG, BIG + 2, BIG + 4, BIG + 6, None}


def found(df, column="doc_id"):
    return {r[0] for r in df.select(column).collect()}


def test_large_ids_next_to_nulls(spark, odd, ids):
    labels = spark.createDataFrame([(BIG, 1), (BIG + 2, 0)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(BIG, text(1)), (None, text(2))], "item_id long, text string").coalesce(1)
    file = queries.tokenizer_file()
    leaks = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, benchmark).collect()}
    assert leaks == {(BIG, BIG), (BIG + 4, BIG), (None, None)}
    assert found(quality.score(odd, quality.learn(odd, labels))) == ids
    assert found(token_counts.count(odd, file)) == ids
    assert found(repair_ids.round_trip(odd, file)) == ids
    assert found(packing.pack_tokens(odd, file)) == ids
    assert found(langid.identify(odd.withColumn("lang", F.lit("en")), langid.learn(odd.withColumn("lang", F.lit("en"))))) == ids
    assert found(fingerprints.fingerprint_documents(odd)) == ids
    assert found(sharding.shard_rows(odd)) == ids
    near = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(odd).collect()}
    assert near == {(BIG, BIG), (BIG + 2, BIG + 2), (BIG + 4, BIG), (BIG + 6, BIG + 6), (None, None)}
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("https://a.test/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.lit("x").alias("host"), F.lit("x").alias("path"), F.lit("x").alias("key"))
    assert found(html_main.extract(pages), "page_id") == ids


def test_stored_nulls_come_back_as_nulls(spark, odd):
    got = repair_ids.round_trip(odd, queries.tokenizer_file()).collect()
    assert sorted(r["start"] for r in got if r["doc_id"] is None) == sorted(r["start"] for r in got)[:2]


def test_short_items_need_the_whole_document(spark):
    docs = spark.createDataFrame([(1, "yes"), (2, "well yes indeed"), (3, "Yes!"), (4, "a b c"), (5, "x a b c y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "a b c")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1), (3, 1), (4, 2)}


def test_tiles_by_length_are_the_tiles():
    rng = np.random.default_rng(1)
    for _ in range(400):
        item, doc = (rng.integers(0, rng.integers(2, 9), rng.integers(1, 50)).astype(np.uint64) * _text.BASE for _ in range(2))
        assert sorted(decontaminate.tiles(item, doc, 4)) == sorted(decontaminate.tiles_by_length(item, doc, 4))
    assert decontaminate.tiles(np.full(3000, 5, np.uint64), np.full(20_000, 5, np.uint64), 4) == [(0, 0, 3000)]


def test_several_benchmark_blocks(spark):
    docs = spark.createDataFrame([(i, text(i)) for i in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(i)) for i in range(3)], "item_id long, text string")
    whole, parts = (decontaminate.contaminated(docs, items, block_bytes=n) for n in (10**6, 100))
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 3
    assert found(decontaminate.without_leaks(docs, items, block_bytes=100)) == {3, 4, 5}


def test_no_pair_is_left_that_pays():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 50, 20_000), np.tile(rng.integers(0, 50, 300), 30), np.full(1000, 7)]).astype(np.uint32)
    seq, rules = repair_ids.compress(ids)
    assert (repair_ids.expand(seq, rules) == ids).all()
    pairs, n = np.unique(seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:], return_counts=True)
    often = pairs[n >= repair_ids.LEAST]
    # What counts as often may only be a run of one symbol, whose overlapping pairs are fewer.
    assert all(p >> np.uint64(32) == p & np.uint64(0xFFFFFFFF) for p in often)


def test_language_shares_at_any_size():
    for total in (10**7, 10**12, 10**14, 10**16):
        got = langid.shares({"a": total, "b": total // 3, "c": 100}, 16_000_000)
        assert all(n > 0 for n in got.values()) and got["c"] == int(2.0**62)
        assert abs(total * got["a"] / 2**62 - min(total, 16_000_000 / 3)) < 100


def test_language_counts_by_hand():
    docs = ["the cat sat on the mat", "le chat est sur le tapis", "the dog and the log"]
    grams = lambda t: [(t + " ").encode()[k : k + 4] for k in range(len(t) - 2)]
    counts = {}
    for lang, t in (("en", docs[0]), ("fr", docs[1])):
        code, within, _ = langid.grams([t])
        counts[lang] = np.unique(code[within], return_counts=True)
    f = langid.Filters(counts, "en")
    n, c = f.counts(docs)
    for i, t in enumerate(docs):
        mine = grams(t)
        assert n[i] == len(mine)
        for k, lang in enumerate(f.languages):
            known = {int.from_bytes(g, "big") for g in grams(docs[0] if lang == "en" else docs[1])}
            hits = sum(int.from_bytes(g, "big") in known for g in mine)
            assert abs(c[i, k] - hits) < 0.5  # the filter is nearly empty, so the correction is slight
    assert f.predict(docs)[0] == ["en", "fr", "en"]


def test_convolution_by_hand():
    rng = np.random.default_rng(5)
    model = quality.fit([text(i, 80) for i in range(40)], np.arange(40) % 2, 0.5, epochs=1)
    for t in ("", "ab", text(3, 30), text(4, 200)):
        raw = t.encode()
        size = -(-(len(raw) + quality.WIDTH - 1) // quality.HALF)
        data = raw.ljust(size * quality.HALF, b"\0")
        want = np.full((size, quality.FILTERS), -1e9)
        for i in range(len(data) - quality.WIDTH + 1):
            want[i // quality.HALF] = np.maximum(want[i // quality.HALF], sum(model.tables[k, data[i + k]] for k in range(quality.WIDTH)))
        padded, first, _ = quality.padded([t])
        assert np.allclose(model.halves(padded, first), want, atol=1e-4)
    texts = [text(int(rng.integers(99)), int(rng.integers(1, 300))) for _ in range(9)]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-6)


def test_learning_is_bounded_and_repeats_count_once(spark):
    docs = spark.createDataFrame([(i % 30, text(i % 30, 50)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert isinstance(quality.learn(docs, labels), quality.Model)
    assert isinstance(quality.learn(docs, labels, train_bytes=10), quality.Constant)


def test_packing_opens_the_least_cost_length():
    bins, starts, final = packing.pack_block([100] * 10 + [900] + [1500], (1000, 2000), overhead=50, attention=1000)
    assert len(bins) == 12 and all(f in (1000, 2000) for f in final)
    for b in set(bins.tolist()):
        mine = sorted((s, n) for s, n, x in zip(starts, [100] * 10 + [900] + [1500], bins, strict=True) if x == b)
        assert [s for s, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))]
    assert final[10] == 1000 and final[11] == 2000  # attention makes 1,000 the cheaper length for what fits


def test_packed_ids_are_the_library_ids(spark):
    from tokenizers import Tokenizer

    file = queries.tokenizer_file()
    library = Tokenizer.from_file(file)
    rows = [(1, text(1, 9000)), (2, "Two words"), (3, None)]
    got = packing.pack_tokens(spark.createDataFrame(rows, "doc_id long, text string"), file, capacities=(64, 512)).collect()
    for i, t in rows:
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])])
        assert ids.tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert all(len(r["ids"]) == 4 * r["piece_length"] and r["bin_start"] + r["piece_length"] <= r["bin_capacity"] for r in got)


def test_other_tokenizers_are_not_taken_apart(tmp_path):
    import json

    from tokenizers import Tokenizer

    rules = json.loads(open(queries.tokenizer_file(), encoding="utf-8").read())
    assert _tokens.splits(rules)
    cased = {**rules, "normalizer": None}
    assert not _tokens.splits(cased)
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(cased))
    texts = ["Some Words, and MORE words", None, "x"]
    got, n, lo, hi = _tokens.encoder(str(path), True).encode(texts)
    want = [Tokenizer.from_file(str(path)).encode(t or "", add_special_tokens=False) for t in texts]
    assert got.tolist() == [i for w in want for i in w.ids] and n.tolist() == [len(w.ids) for w in want]
    assert list(zip(lo.tolist(), hi.tolist(), strict=True)) == [o for w in want for o in w.offsets]


def test_differencing_decides_before_markup():
    page = "<nav><a href=1>Menu line</a></nav><div>Site slogan</div><article><h1>Title</h1><p>Licence text of both</p><p>Own text</p><p><a href=2>Read this too</a></p></article><div class=comments>A reader says</div>"
    fate = dict(html_main.decide(html_main.candidates(page), ["Menu line", "Site slogan", "Licence text of both", "Read this too", "Other"]))
    assert fate == {"Menu line": "shared", "Site slogan": "shared", "Title": "kept", "Licence text of both": "kept", "Own text": "kept", "Read this too": "shared", "A reader says": "ruled"}
    assert html_main.main_text(html_main.candidates(page), None) == "Title\n\nLicence text of both\n\nOwn text\n\nRead this too"


def test_many_equal_lines_are_aligned():
    a, b = ["x", "y"] * 4000, ["x"] * 6000 + ["y"] * 2000
    assert len(html_main.common(a, b)) == 4001  # all x, and the last y


def test_runs_of_copies_over_many_tasks(spark):
    """Pairing with a plain loop over the sorted pages gives the same texts."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        body = "<p>copied body</p>" if 60 < i < 330 else f"<p>body {rng.randint(0, 3)}</p>"
        rows.append((i, f"https://h{i // 200}.test/a/{i:04}", f"<div>slogan</div>{body}<p>tail {i % 3}</p>" if not 60 < i < 330 else f"<div>slogan</div>{body}"))
    made = [html_main.candidates(h) for _, _, h in rows]
    want = {}
    for i, (_, url, _) in enumerate(rows):
        host, path = url[8:].split("/", 1)
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(rows) and rows[j][1][8:].split("/", 1)[0] == host and html_main.own(made[j]) == html_main.own(made[i]):
                j += step
            if 0 <= j < len(rows) and rows[j][1][8:].split("/", 1)[0] == host:
                near.append((host, "/" + rows[j][1][8:].split("/", 1)[1], [x[0] for x in made[j][0]]))
        best = max(near, key=lambda x: len(__import__("os").path.commonprefix([x[1], "/" + path])), default=None)
        want[i] = html_main.main_text(made[i], best and best[2])
    held, html_main.MOST_HELD = html_main.MOST_HELD, 7
    try:
        got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        html_main.MOST_HELD = held
    assert got == want
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_streamed_runs_are_the_runs():
    """Pairs and dense ids do not depend on how the rows are cut into batches."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        label = np.sort(rng.integers(0, 4, (n, 1)), axis=0).astype(np.uint32).repeat(neardup.DEPTH, 1)
        rep, tree, size = np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)
        out = []
        for cuts in ([], sorted(rng.integers(0, n, 5).tolist())):
            runs, pairs, hot = neardup.Runs(4), set(), set()
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                if b > a:
                    x, y, h = runs.feed(tree[a:b], label[a:b], rep[a:b], size[a:b])
                    pairs |= set(zip(x.tolist(), y.tolist(), strict=True))
                    hot |= set(h.tolist())
            out.append((pairs, hot))
        assert out[0][1] == out[1][1] and out[0][0] <= out[1][0]


def test_order_minhash_by_hand(spark):
    """The signature, recomputed from the grams' hashes that Spark gives."""
    rows = [(1, "a b c d e f g a b c d"), (2, text(9, 40)), (3, "one two"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["sig"] for r in fingerprints.with_signature(df, "text", "sig").collect()}
    shift, mask, low = 64 - fingerprints.BUCKETS_LOG2, (1 << 64) - 1, fingerprints.POS
    for i, t in rows:
        w = t.split()
        grams = [w[k : k + 3] for k in range(len(w) - 2)] if len(w) >= 3 else []
        query = [tuple(g) for g in grams] or ([(" ".join(w),)] if w else [])
        hashes = [spark.range(1).select(F.xxhash64(*[F.lit(x) for x in g])).collect()[0][0] & mask for g in query]
        seen, keyed = {}, []
        for place, h in enumerate(hashes):
            h &= ~low & mask
            o = seen.get(h, 0)
            seen[h] = o + 1
            signed = h - (1 << 64) if h >> 63 else h
            mixed = spark.range(1).select(F.xxhash64(F.lit(signed).cast("long"), F.lit(o))).collect()[0][0] & mask
            keyed.append(((mixed & ~low & mask) | place, place))
        for b in range(1 << fingerprints.BUCKETS_LOG2):
            mine = sorted(((x - (1 << 64)) if x >> 63 else x) & mask for x, _ in keyed if x >> shift == b)[: fingerprints.KEPT]
            assert (got[i][b] is None) == (not mine)



def _plain_repair(seq, least):
    """Rounds of Re-Pair by plain counts over the whole sequence."""
    rules = []
    while True:
        pairs = list(zip(seq, seq[1:], strict=False))
        frequent = [p for p in dict.fromkeys(pairs) if pairs.count(p) >= least]
        if not frequent:
            return seq, rules
        name = {p: repair_ids.FIRST_RULE + len(rules) + k for k, p in enumerate(frequent)}
        rules += frequent
        out, i = [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) in name:
                out.append(name[tuple(seq[i : i + 2])])
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq = out


def test_repair_equals_plain_counts():
    r = np.random.default_rng(3)
    for _ in range(300):
        ids = r.integers(0, r.integers(1, 6), r.integers(0, 90)).astype(np.int32)
        seq, rules = repair_ids.compress(ids)
        want_seq, want_rules = _plain_repair(ids.tolist(), repair_ids.LEAST)
        assert seq.tolist() == want_seq
        assert [tuple(x) for x in rules.tolist()] == want_rules
        assert repair_ids.expand(seq, rules).tolist() == ids.tolist()


def test_repair_in_rounds_over_many_pairs():
    """Long enough for the hashed first counts."""
    ids = np.tile(np.random.default_rng(4).integers(0, 300, 20_000), 5).astype(np.int32)
    seq, rules = repair_ids.compress(ids)
    assert len(seq) < len(ids) // 4 and repair_ids.expand(seq, rules).tolist() == ids.tolist()


def test_pages_are_packed_between_stages(spark):
    """Pages are dealt out as packed lines, not as html, and tables between stages are packed; null and empty pages come through."""
    pages = spark.createDataFrame([(1, "https://a.com/x", "<article><p>One text here</p></article>"), (2, "https://a.com/y", None), (3, None, "")], "page_id long, url string, html string")
    out = html_main.extract(pages)
    assert all(f.endswith(".zstd.parquet") for f in out.inputFiles()) and out.inputFiles()
    assert [tuple(r) for r in out.orderBy("page_id").collect()] == [(1, "https://a.com/x", "One text here", 13), (2, "https://a.com/y", "", 0), (3, None, "", 0)]
