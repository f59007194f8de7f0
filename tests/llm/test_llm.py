"""Each training-data operator on a small table with nulls, empty, long and repeated texts, ties and clashing columns, held
against a brute-force version; and on the whole of a small test table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm._spark import Scratch
from tracewell.llm import decontaminate, fingerprints, html_main, langid, neardup, packing, quality, repair_ids, sharding, token_counts
from tracewell.llm import _text, _tokens, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, cell int, helper string, rng long, key string, length long, component string"


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    texts = [None, "", "   \n", "one", "One", "two words", "Ünï — ’s don't 12", "x" * 3000, " ".join(vocab * 20)]
    for b in base:
        w = b.split()
        texts.append(b)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
        texts.append(b.upper())
    for k in range(14):  # a dense region: more near copies than a run pairs in full
        v = base[0].split()
        v[k] = f"edit{k}"
        texts.append(" ".join(v))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, 1, 2, "h", 3, "k", 4, "c") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Near-duplicates


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, words, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, words, percent).collect()}
    assert got == brute_components(corpus(), words, percent)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark, none):
    assert neardup.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(rows).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("8", "8", True), ("None", "None", True)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600)], "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in neardup.components(links, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 600: 500}


# Sharding


def test_sharding(docs, none):
    rows = sharding.shard_rows(docs).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    text = dict(corpus())
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["law"] == "rows" for r in rows)
    assert sharding.shard_rows(none).count() == 0


def test_overflow_goes_clockwise():
    owners = [0, 0, 1, 1]
    pieces = {p["cell"]: (p["froms"], p["shards"], p["slots"]) for p in sharding.deal({0: 5, 1: 1, 2: 0, 3: 1}, owners, 2)}
    assert pieces == {0: ([0, 4], [0, 1], [0, 1]), 1: ([0], [1], [2]), 3: ([0], [1], [0])}


# Fingerprints


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    rows = corpus()
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1
        j = rows[(k + 1) % len(rows)][0]
        a, b = (re.findall("........", got[x]["fingerprint"]) for x in (i, j))
        filled = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" * 8 or y != "-" * 8]
        assert got[i]["near_next"] == (sum(x == y for x, y in filled) / len(filled) if filled else 1.0)
    assert got[1]["fingerprint"] == got[0]["fingerprint"] == "-" * 256
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_one_document_is_its_own_next(spark):
    row = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()[0]
    assert row["near_next"] == 1.0


def test_order_matters(spark):
    w = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(w)), (2, " ".join(w[150:] + w[:150])), (3, " ".join(w))]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["fingerprint"] == got[2]["fingerprint"] and 0.2 < got[0]["near_next"] < 0.9


# Packing


def test_packing(spark, none):
    sizes = [0, 5, 40, 40, 16, 16, 16, 3, 100, 7]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(None, 4), (99, None)], "doc_id long, n long").coalesce(1)
    got = packing.pack(rows, "n", capacities=(8, 16, 32), overhead=2).collect()
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["piece_length"]
    assert per == Counter({**dict(enumerate(sizes)), None: 4, 99: 0})
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for b in bins.values():
        used = sum(r["piece_length"] for r in b)
        assert b[0]["bin_capacity"] == min(c for c in (8, 16, 32) if c >= used)
        at = 0
        for r in sorted(b, key=lambda r: (r["bin_start"], r["piece_length"])):
            assert r["bin_start"] == at
            at += r["piece_length"]
    assert packing.pack(none, "length").count() == 0


# Language, quality


def test_languages(spark, none):
    text = {"aa": "the cat and the dog sat with the hat ", "bb": "le chat et le chien dans la maison une "}
    rows = [(i, text[k] * 3 + str(i), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "12 !!", "aa"), (902, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:80])
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert langid.identify(none, langid.learn(none)).count() == 0
    assert langid.identify(docs, langid.learn(none)).where("lang_pred <> 'und'").count() == 0


def test_filters_return_all_languages_of_a_gram():
    f = langid.Filters({k: np.unique(langid.grams([t])[0], return_counts=True) for k, t in {"a": "shared words", "b": "shared parts"}.items()}, "a")
    code, within, _ = langid.grams(["shar"])
    s = langid.slots(code[within][:1])
    assert f.masks[0][s[0]] & f.masks[0][s[1]] == 3


def test_quality(spark, docs, none):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("%%%" if i % 3 == 0 else "") for _ in range(rng.randint(1, 120)))) for i in range(400)]
    table = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(table, quality.learn(table, labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == (i % 3 != 0) for i in held]) > 0.95
    assert 0 <= got[1000]["score"] == got[1001]["score"] <= 1
    nothing = labels.where("false")
    assert {r["score"] for r in quality.score(table, quality.learn(table, nothing)).collect()} == {0.5}
    assert quality.score(none, quality.Constant(0.5)).count() == 0


def test_chunks_do_not_depend_on_neighbours():
    texts = ["a%%% b " * 60, "", "plain words here " * 40, "x"]
    y = np.array([0, 1, 1, 1])
    model = quality.fit(texts * 10, np.tile(y, 10), 0.75, epochs=1)
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-5)


# Decontamination


def greedy(item, doc, least):
    """String tiling by its definition: again and again mark the longest match of unmarked words."""
    a, b, n = [0] * len(item), [0] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return n
        k, i, j = best
        a[i : i + k] = b[j : j + k] = [1] * k
        n += k


def test_tiling_covers_as_much_as_by_definition():
    rng = random.Random(5)
    for _ in range(40):
        item, doc = [rng.randrange(4) for _ in range(20)], [rng.randrange(4) for _ in range(40)]
        mine = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert sum(n for _, _, n in mine) == greedy(item, doc, 3)


def test_reordered_passages_are_found(spark, none):
    item = " ".join(f"t{i}" for i in range(20))
    moved = " ".join([f"t{i}" for i in range(10, 20)] + ["and", "then"] + [f"T{i}," for i in range(10)])
    docs = spark.createDataFrame([(1, moved), (2, "t1 t2 t3 only"), (3, None), (4, item), (4, item), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "hi"), (10, "")], "item_id long, text string")
    for size in (16_000_000, 1):
        got = sorted((str(r["doc_id"]), r["item_id"], r["coverage"]) for r in decontaminate.contaminated(docs, bench, block_bytes=size).collect())
        assert got == [("1", 7, 1.0), ("4", 7, 1.0), ("4", 7, 1.0), ("None", 7, 1.0)]
    assert decontaminate.without_leaks(docs, bench).select("doc_id").orderBy("doc_id").collect() == [(2,), (3,)]
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0 == decontaminate.contaminated(none, bench).count()


# HTML


def test_words_of_any_script():
    items = ["机器学习是人工智能的一个重要分支", "He said it “was” so—then left the room", "เครื่องจักรเรียนรู้", "été à Zürich हिन्दी"]
    docs = ["前言。我们知道机器学习是人工智能的一个重要分支，所以学习它。", "x He said it was so then left the room y", "ก่อนเครื่องจักรเรียนรู้หลัง", "l\u2019été\u00a0à Zürich\u2026हिन्दी!", "与此无关的一段文字"]
    got = {(d, k): cover for d, k, cover, *_ in decontaminate.Items(list(range(4)), items).leaks(docs, 0.5)}
    assert got == {(i, i): 1.0 for i in range(4)}
    assert decontaminate.spaced("a\u2014b 中文") == "a b  中  文 "


def test_markup_and_differencing(spark):
    head = "<!doctype html><title>x</title><script>var a='</p>';</script><div>Site name</div><nav><a href=1>menu</a></nav>"
    rows = [
        (1, "https://a.test/x/1", head + "<div>First&nbsp;text &amp; more</div><p>Shared line<p>Own one, which is long enough</div><div class='comments'>bad</div>"),
        (2, "https://www.a.test/x/2", head + "<div>Second  text</div><p>Shared line<p>Own two, which is long enough too</p>"),
        (3, "https://b.test/only", "<article><header>h</header><h1>T</h1><p>One <b>two</b><br>three<form>f</form><aside>s</aside><p>Four"),
        (4, None, None),
        (5, "https://c.test/1", "<p>copy of a text</p>"),
        (5, "https://c.test/1", "<p>copy of a text</p>"),
    ]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert text == {1: "First text & more\n\nOwn one, which is long enough", 2: "Second text\n\nOwn two, which is long enough too", 3: "T\n\nOne two three\n\nFour", 4: "", 5: "copy of a text"}
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)


def test_differencing_passes_over_copies(spark):
    template = "<div>Site name of some length</div><div>A long slogan that is on every page of this site</div>"
    article = "<article><p>Own words of it</p><p><a href=x>The source of the story</a></p></article>"
    rows = [(i, f"https://a.test/x/{i:02}", f"{template}<p>short</p>") for i in range(20)] + [(20, "https://a.test/x/20", f"{template}<p>other</p>")]
    rows += [(i, f"https://b.test/{i}", article) for i in (30, 31)] + [(32, "https://b.test/32", "<article><p>Else</p></article>")]
    rows += [(40, "https://c.test/1", "<p>only copies</p>"), (41, "https://c.test/2", "<p>only copies</p>")]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: "short" for i in range(20)} | {20: "other", 30: "Own words of it\n\nThe source of the story", 32: "Else", 40: "only copies", 41: "only copies"}
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want | {31: want[30]}


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(html_main.common(a, b)) == table[-1][-1]


# Tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


def test_pieces_give_the_library_ids(tokenizer):
    texts = [t for _, t in corpus()] + ["<|endoftext|> a <|startoftext|>b", "é É × ÷ é", "ﬁ 日本 x", "a\x01b\x7f 1a2 'tis ...!!"]
    for offsets in (False, True):
        ids, n, lo, hi = _tokens.encoder(queries.tokenizer_file(), offsets).encode(texts)
        at = 0
        for t, k in zip(texts, n, strict=True):
            want = tokenizer.encode(t or "", add_special_tokens=False)
            assert ids[at : at + k].tolist() == want.ids
            if offsets:
                assert list(zip(lo[at : at + k].tolist(), hi[at : at + k].tolist(), strict=True)) == want.offsets
            at += k


def test_token_files_round_trip(docs, none, tokenizer):
    got = {r["doc_id"]: r for r in repair_ids.round_trip(docs, queries.tokenizer_file()).collect()}
    at = 0
    for i, t in corpus():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert repair_ids.round_trip(none, queries.tokenizer_file()).count() == 0


def test_grammar_and_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile([5, 6, 7, 8], 500), rng.integers(0, 9, 3000), np.full(400, 3)]).astype(np.int32)
    seq, rules = repair_ids.compress(ids)
    lengths = repair_ids.rule_lengths(rules)
    assert len(seq) < len(ids) / 2 and (repair_ids.expand(seq, rules) == ids).all()
    pack = repair_ids._pack
    shard = repair_ids.Shard(pack(rules, "<u4"), pack(lengths, "<u4"), pack(seq, "<u4"), pack(repair_ids.symbol_places(seq, lengths), "<i8"), len(ids))
    for a, b in [(0, 1), (17, 900), (1999, 2003), (len(ids) - 1, len(ids)), (5, 5), (0, len(ids))]:
        assert (shard.decode(a, b) == ids[a:b]).all()


def test_section_counts(docs, none, tokenizer):
    text = dict(corpus())
    for rule in ("start", "end", "majority"):
        got = token_counts.count(docs, queries.tokenizer_file(), rule, width=50).collect()
        per = Counter()
        for r in got:
            per[r["doc_id"]] += r["n_tokens"]
        assert per == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in text.items()}
        i = next(i for i, t in text.items() if t and t.startswith("xxx"))
        want = Counter()
        for lo, hi in tokenizer.encode(text[i], add_special_tokens=False).offsets:
            first, last = lo // 50, (hi - 1) // 50
            part = lambda k: min(hi, 50 * k + 50) - max(lo, 50 * k)  # noqa: B023, E731
            want[{"start": first, "end": last, "majority": max(range(first, last + 1), key=lambda k: (part(k), -k))}[rule]] += 1
        assert {r["section"]: r["n_tokens"] for r in got if r["doc_id"] == i and r["n_tokens"]} == want
    assert token_counts.count(none, queries.tokenizer_file()).count() == 0


# Queries and the pipeline


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline", "op12_parity_bands"}))  # the latter returns words
def test_queries_return_whole_tables(spark, name):
    got = queries.QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if name.startswith("op6") else ("documents", "doc_id")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    found = got.select(key).distinct().count()
    assert found <= n if name.startswith("op1_") else found == n


def test_pipeline(spark, tokenizer):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {i: t for i, t in want.items() if re.search(r"[^\W\d_]", t or "") and model.scores([t])[0] >= 0.3}
    kept = {i: good[i] for i, (_, _, first) in brute_components(sorted(good.items()), 5, 80).items() if first}
    items = decontaminate.Items(*zip(*[(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], strict=True))
    clean = {i: t for i, t in kept.items() if not items.leaks([t], 0.5)}
    size = Counter()
    for r in p.run(spark, SF).collect():
        size[r["doc_id"]] += r["piece_length"]
    assert size == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}


def test_stages_keep_columns_and_odd_rows(spark):
    import corpus_pipeline as p

    good = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", None, None, 0), (None, "some plain words of text here", "en", None, None)], good.schema)
    docs = good.unionByName(odd).unionByName(odd).withColumn("label", F.lit(1)).withColumn("key", F.lit("k"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    """Different texts under one doc_id, or under none, all stay; of copies one does, that of a single doc_id if there is one."""
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a), (None, c), (None, d), (None, d), (3, c + " more"), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in p.drop_near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(1, b), (2, a), (None, d), (3, c + " more"), (4, None), (4, None), (5, "")])


def test_range_hashes():
    data = np.frombuffer(b"abc xabc abcd", np.uint8)
    h = _text.range_hashes(data, np.array([0, 5, 9]), np.array([3, 8, 12]))
    assert h[0] == h[1] == h[2]
