"""Edge cases of the training-data operators: nulls, empty texts, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, decontaminate, extract, jaccard, licenses, media, mixing, pitman_yor, quality, sharding
from docloom.llm.entries import ORACLE_SQL  # noqa: F401
from docloom.session import store, table

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"t{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE + " tail", "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "Two words", "fr", "b"), (5, "Two words", "fr", "b"),
    (None, BASE, "en", "a"), (7, LONG, "en", "a"), (8, BASE, "en", None), (9, "MIT License and CC BY-NC 4.0", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in ("tokens", "quality", "slot", "key", "kept", "h", "n")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def test_jaccard(docs, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()), key=str)
    long_set = len({tuple(LONG.split()[i : i + 4]) for i in range(30_000 - 3)})
    assert got == sorted([(1, 57, 1), (2, 58, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5), (None, 57, None), (7, long_set, 7), (8, 57, 1), (9, 3, 9)], key=str)
    assert jaccard.similar_documents(none).count() == 0


def test_frequent_filter():
    rng = random.Random(1)
    keys = np.array(sorted(rng.randrange(1 << 48) for _ in range(5000)), np.uint64)
    own = jaccard.buckets(keys, 7)
    held = jaccard.Frequent([jaccard.Frequent.slice_of(keys[own == b], 12_000) for b in range(7)], 12_000)
    others = np.array([rng.randrange(1 << 48) for _ in range(20_000)], np.uint64)
    assert held.has(keys).all() and held.has(others).mean() < 0.01
    assert not jaccard.Frequent([], 8).has(keys).any()


@pytest.mark.parametrize("bits", [1 << 29, 64])
@pytest.mark.parametrize("rows", [1_000_000, -1])
def test_jaccard_with_full_filters_and_shuffled_joins(spark, monkeypatch, bits, rows):
    """Hot leaders, a filter that takes most tokens for frequent and no broadcast give what plain Python gives."""
    rng = random.Random(4)
    base, texts = [f"b{i}" for i in range(80)], []
    for k in range(160):
        words = list(base) if k % 2 else [f"c{k % 9}x{i}" for i in range(50)]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(300)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    root = list(range(160))
    for _ in range(8):
        for i in range(160):
            for j in range(160):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    monkeypatch.setattr(jaccard, "MOST_BITS", bits)
    monkeypatch.setattr("docloom.session.BROADCAST_ROWS", rows)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(df, rare=3).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < 160


@pytest.mark.parametrize("block", [1, 150, 50_000])
def test_jaccard_families_in_blocks(spark, monkeypatch, block):
    rng = random.Random(block)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        words = base[: rng.choice([60, 60, 55, 40])]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    root = list(range(90))
    for _ in range(8):
        for i in range(90):
            for j in range(90):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(df, rare=2).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < 90


def test_lm(docs, none):
    got = pitman_yor.score_documents(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[3] == 1 and all(r.score < 0 for r in got)
    assert pitman_yor.score_documents(none).count() == 0


def test_lm_split_buckets(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("the" if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 80))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "the the")], "doc_id long, text string").repartition(4).cache()
    seen, stored = {}, []
    monkeypatch.setattr(pitman_yor, "store", lambda df, name: stored.append(name) or store(df, name))
    for chunk in (1_000_000, 200):
        assert "split-restaurants" not in stored  # one chunk a partition is never split
        out = pitman_yor.score_documents(df, bucket_bytes=2500, chunk=chunk)
        seen[chunk] = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()}
    assert stored.count("split-restaurants") == 1 and len(seen[200]) == 401
    assert all(seen[200][i] == pytest.approx(x, abs=1e-3) for i, x in seen[1_000_000].items())
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.split(), ""]) + Counter(["the", "the", ""])
    total, known = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = [*t.split(), ""]
        base = sum(math.log10((counts[w] + 1) / (total + known + 1)) for w in words)
        n, k, trained, got, _ = seen[200][i]
        assert (n, k, trained) == (len(words), sum(counts[w] > 0 for w in words), total) and abs(got - base) < 1e-6


def test_lm_stirling_numbers():
    """Against the sum over all seatings, and the form for many customers against the exact one."""

    def ways(sizes, left, d):
        if not left:
            return {len(sizes): 1.0}
        out = Counter()
        for i, n in enumerate(sizes):
            for t, w in ways([*sizes[:i], n + 1, *sizes[i + 1 :]], left - 1, d).items():
                out[t] += w * (n - d)
        for t, w in ways([*sizes, 1], left - 1, d).items():
            out[t] += w
        return out

    exact = pitman_yor.stirling(0.7)
    for t, w in ways([1], 6, 0.7).items():
        assert exact[7, t] == pytest.approx(math.log(w))
    for d in (0.3, 0.5, 0.7, 0.9):
        t = np.arange(1.0, 64.0)
        off = pitman_yor.stirling_many(np.full(63, 64.0), t, d) - pitman_yor.stirling(d)[64, 1:64]
        few = t <= min(64**d, 32)
        assert np.abs(off[few]).max() < 1e-5 and np.abs(off[~few]).max() < 0.7 and np.abs(np.diff(off[~few])).max() < 0.1


def test_lm_gibbs_equals_a_plain_sampler():
    """Average predictions of the sampler by dishes and of one that seats customer by customer, at explicit tables."""
    rng = random.Random(8)
    words = [rng.choice("aaaaabbbccd") for _ in range(160)]
    counts = Counter(zip(words, words[1:]))
    vocabulary, d, top, base = sorted(set(words)), 0.6, 0.5, 1 / (len(set(words)) + 1)
    theta = pitman_yor.STRENGTH
    tables = {(v, w): [1] * n for (v, w), n in counts.items()}  # sizes of a dish's tables
    above = {w: [1] * sum(len(x) for (_, y), x in tables.items() if y == w) for w in vocabulary}

    def parent(w):
        c, t = sum(map(sum, above.values())), sum(map(len, above.values()))
        return (sum(above[w]) - top * len(above[w]) + (theta + top * t) * base) / (theta + c)

    def sit(sizes, weight, discount):
        pick = rng.random() * (sum(sizes) - discount * len(sizes) + weight)
        for i, n in enumerate(sizes):
            pick -= n - discount
            if pick < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def rise(sizes):
        pick = rng.randrange(sum(sizes))
        for i, n in enumerate(sizes):
            pick -= n
            if pick < 0:
                sizes[i] -= 1
                if not sizes[i]:
                    del sizes[i]
                    return True
                return False

    total, kept = Counter(), 0
    for sweep in range(1200):
        for (v, w), n in counts.items():
            for _ in range(n):
                if rise(tables[v, w]):
                    rise(above[w])
                own = sum(len(x) for (y, _), x in tables.items() if y == v)
                if sit(tables[v, w], (theta + d * own) * parent(w), d):
                    sit(above[w], (theta + top * sum(map(len, above.values()))) * base, top)
        if sweep >= 100:
            kept += 1
            for v in vocabulary:
                c, t = (sum(f(x) for (y, _), x in tables.items() if y == v) for f in (sum, len))
                for w in vocabulary:
                    x = tables.get((v, w), [])
                    total[v, w] += (sum(x) - d * len(x) + (theta + d * t) * parent(w)) / (theta + c)

    order = [(w, v) for w in vocabulary for v in vocabulary]
    trained = np.array([counts[v, w] for w, v in order])
    contexts = np.array([vocabulary.index(v) for _, v in order])
    seated = np.bincount(contexts, trained).astype(np.int64)
    prior = pitman_yor.Prior(len(words), len(vocabulary), d, top)
    bucket = pitman_yor.Bucket(0, pitman_yor.pack(np.full(len(vocabulary), len(vocabulary))), pitman_yor.pack(contexts), pitman_yor.pack(trained), [pitman_yor.pack(seated)], prior)
    at = np.bincount(contexts, bucket.tables).astype(np.int64)
    sizes, mean, draw = pitman_yor.Sizes(int(bucket.parents.sum()), int(bucket.parent_tables.sum())), np.zeros(len(order)), np.random.default_rng(3)
    for sweep in range(3000):
        sizes, at = bucket.sweep(draw, sizes, at)
        assert sizes == (bucket.parents.sum(), bucket.parent_tables.sum()) and (at == np.bincount(contexts, bucket.tables)).all()
        if sweep >= 200:
            mean += bucket.predict(sizes, at) / 2800
    plain = np.array([total[v, w] / kept for w, v in order])
    print(np.abs(np.log(mean / plain)).max(), np.abs(mean - plain).max())
    assert np.abs(mean - plain).max() < 0.012 and np.abs(np.log(mean / plain)).mean() < 0.03


def test_lm_beats_a_kneser_ney_bigram(spark):
    """Held-out perplexity at sf0.01 is no worse than what a plain interpolated Kneser-Ney bigram with exact contexts has (2,955)."""
    r = pitman_yor.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert 10 ** (-r[0] / r[1]) < 2955


def test_lm_each_word_is_a_context_of_its_own(spark):
    """400,000 words, each with one follower: a text of seen pairs scores as with 1,000 words, for no other word's followers count."""
    test, *train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:1] + [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    each = []
    for many in (500, 200_000):
        texts = [" ".join(f"a{i} b{i}" for i in range(k, k + 500)) for k in range(0, many, 500)]
        rows = [(test, " ".join(f"a{i} b{i}" for i in range(400))), *[(train[2 * k + c], t) for k, t in enumerate(texts) for c in (0, 1)]]
        got = pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=1 << 20).where("held_out").first()
        each.append(got.score / got.n_tokens)
    print(each)
    assert each[1] == pytest.approx(each[0], abs=0.1)


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"T{i}" for i in range(10, 40))), (2, None), (3, "two WORDS"), (4, "not there at all ever")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()) == [(1, 1), (2, 1), (5, 3), (8, 1)]
    assert sorted((r.doc_id for r in decontaminate.decontaminate(docs, items).collect()), key=str) == [3, 4, 7, 9, None]
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(docs, items.where("item_id < 0")).count() == 0


def test_decontamination_search_by_sketch_alone(spark):
    """What the sketch finds holds every pair that counts, and a document with every other shingle of an item is not found."""
    rng = random.Random(11)
    lengths = [1, 3, 5, 6, 9, 12, 20, 21, 40, 70, 140, 300]
    bodies = [[f"i{i}x{j}" for j in range(n)] for i, n in enumerate(lengths)]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bodies)], "item_id long, text string")
    docs = []
    for k in range(150):
        words = [f"f{rng.randrange(500)}" for _ in range(rng.randrange(40))]
        for body in rng.sample(bodies, 3):
            part = [w if rng.random() > rng.choice([0, 0.02, 0.05, 0.1]) else f"n{rng.randrange(99)}" for w in body]
            words += part + [f"f{rng.randrange(500)}" for _ in range(rng.randrange(9))]
        docs.append((k, " ".join(words)))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for d, text in docs:
        for i, body in enumerate(bodies):
            n = min(5, len(body))
            own = grams(body, n)
            hits = len(own & grams(text.split(), n))
            if hits * 1000 >= 800 * len(own):
                want[d, i] = hits
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id): r.hits for r in decontaminate.find_leaks(df, items).collect()} == want and len(want) > 100
    index = store(decontaminate.item_index(items), "items").cache()
    found = {(r.doc_id, r.item_id) for r in decontaminate.search(df, index).join(index, "item").collect()}
    assert want.keys() <= found
    sketched = {r.item_id: set(r.sketch) for r in index.collect()}
    every = {r.item_id: r.m for r in index.collect()}
    assert all(len(sketched[i]) < every[i] for i in (8, 9, 10, 11)) and {r.part for r in index.collect()} == {8, 16, 32, 64, 128, 256, 512}
    # a text of all the words of an item whose shingles are in no sketch
    names = {r.h: r.g for r in index.where("item_id = 11").select(F.explode(F.arrays_zip(F.col("grams"))).alias("z")).select(F.col("z.grams").alias("g")).withColumn("h", decontaminate.shingles(F.split("g", " "), 5)[0]).collect()}
    rest = " . ".join(g for h, g in names.items() if h not in sketched[11])
    assert decontaminate.search(spark.createDataFrame([(1, rest)], "doc_id long, text string"), index).count() == 0


def test_extract(spark):
    page = '<body><nav><a href=x>m</a></nav><div class="post-1"><h1>A &amp; B</h1><p>Text, one.<p>Two<div class="comments"><p>no</p></div></div><footer>f</footer>'
    rows = spark.createDataFrame([(1, "http://h.x/1", page), (1, "http://h.x/1", page), (2, None, None), (3, "http://h.x/3", "")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract.extract_pages(rows).collect())
    assert got == [(1, "A & B\nText, one.\nTwo", 20)] * 2 + [(2, "", 0), (3, "", 0)]
    assert extract.extract_pages(rows.where("page_id < 0")).count() == 0


def test_extract_nested_wrappers_and_two_templates(spark):
    say = lambda word, n: " ".join([word] * n)
    wrapped = f"<body><article><h1>Title</h1><p>Lead</p><div class=wrap><div class=content><p>{say('body', 200)}</p></div></div></article></body>"
    halves = f"<body><article><div class=entry><section class=body><p>{say('most', 140)}</p></section><section class=notes><p>{say('rest', 60)}</p></section></div></article></body>"
    news = f"<body><div class=page><div class=text><p>{say('news', 100)}</p></div></div></body>"
    # the other template holds an element at the first one's path, too
    shop = f"<body><div class=page><div class=text><p>Short teaser</p></div><div class=goods><p>{say('goods', 100)}</p></div></div></body>"
    pages = [(1, "http://a.x/1", wrapped), (2, "http://b.x/1", halves)] + [(10 + i, f"http://c.x/{i}", news) for i in range(4)] + [(20, "http://c.x/20", shop)]
    got = {r.page_id: (r.text, r.path_votes) for r in extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("\n".join(["Title", "Lead", say("body", 200)]), 1)
    assert got[2] == ("\n".join([say("most", 140), say("rest", 60)]), 1)
    assert all(got[10 + i] == (say("news", 100), 4) for i in range(4)) and got[20] == (say("goods", 100), 4)


def test_mixing(docs, none):
    got = mixing.mix(docs, fraction=1.0).select("doc_id", "tokens_", "probability", "kept_").collect()
    assert len(got) == len(ROWS) and all(0 <= r.probability <= 1 for r in got)
    assert not any(r.kept_ for r in got if not r.tokens_) and mixing.mix(none).count() == 0


def test_mixing_small_sources_beside_a_hot_one(spark, caplog):
    """The sample has the wanted size, and each source its target or, where that is more than there is, all it has."""
    sizes = {"hot": 3333, **{f"mid{i}": 400 for i in range(15)}, "s2": 200, "s04": 40, "s01": 10, "s005": 5}
    rows = [(i, "w " * 9 + "w", f"l{i % 4}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("source").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("p")).collect()
    total = sum(r.t for r in got)
    assert sum(r.p for r in got) == pytest.approx(0.5 * total, rel=2e-3)
    raised = {r.source: (r.t / total) ** 0.7 for r in got}
    target = {s: x / sum(raised.values()) * 0.5 * total for s, x in raised.items()}
    share, times = {r.source: r.t for r in got}, 1.0
    for _ in range(50):
        full = sum(share[s] for s in share if times * target[s] >= share[s])
        times = (0.5 * total - full) / sum(target[s] for s in share if times * target[s] < share[s])
    for r in got:
        assert r.p == pytest.approx(min(share[r.source], times * target[r.source]), rel=3e-3)
    assert "source=s005" in caplog.text and "cannot be met" in caplog.text


def test_mixing_full_cells_leave_their_share_to_others(spark):
    """A cell with less than its raked share is kept whole, and the rest of its source and language makes up for it."""
    plan = {("a", "x"): 20, ("a", "y"): 900, ("b", "x"): 700, ("b", "y"): 2000, ("c", "x"): 80, ("c", "y"): 300}
    rows = [(i, "w " * 9 + "w", g, s) for i, (s, g) in enumerate(c for c, n in plan.items() for _ in range(n))]
    powers = {"source": 0.2, "lang": 0.5, "topic": 1.0}
    docs = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 0.3, powers).cache()
    assert docs.where("weight * 0.3 > 1").count() > 0
    for d in ("source", "lang"):
        got = docs.groupBy(d).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("p")).collect()
        raised = [(r.t / 40_000) ** powers[d] for r in got]
        assert [r.p for r in got] == pytest.approx([x / sum(raised) * 12_000 for x in raised], rel=2e-3)


def test_mixing_rakes_until_marginals_hold(spark, caplog):
    powers = {"source": 0.3, "lang": 1.0, "topic": 1.0}

    def off(cells):
        rows = mixing.fit_cells(spark.createDataFrame([(*c, "note", n) for c, n in cells.items()], "source string, lang string, topic string, tokens long"), powers).collect()
        sums, own = Counter(), Counter()
        for r in rows:
            sums[r.source] += r.weight
            own[r.source] += r.tokens
        raised = {s: (n / sum(own.values())) ** 0.3 for s, n in own.items()}
        return max(abs(sums[s] / raised[s] * sum(raised.values()) - 1) for s in own)

    assert off({("a", "x"): 100_000, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 3000}) < 2e-3 and "cannot be met" not in caplog.text
    # a language for each source: source targets are out of reach, and that is said
    assert off({("a", "x"): 1000, ("b", "y"): 300}) > 0.1 and "cannot be met" in caplog.text and "source=b" in caplog.text


def test_mixing_to_given_shares(spark):
    plan = {("a", "x"): 300, ("a", "y"): 900, ("b", "x"): 700, ("b", "y"): 1500, ("c", "x"): 280, ("c", "y"): 320}
    rows = [(i, "w " * 9 + "w", g, s) for i, (s, g) in enumerate(c for c, n in plan.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, 0.2, {"lang": 1.0}, targets={"source": {"a": 0.6, "c": 0.1, "absent": 0.0}}).cache()
    for d, want in (("source", {"a": 0.6, "b": 0.3, "c": 0.1}), ("lang", {"x": 0.32, "y": 0.68})):
        sums = {r[0]: r[1] for r in got.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability"))).collect()}
        assert {k: v / sum(sums.values()) for k, v in sums.items()} == pytest.approx(want, rel=3e-3) and sum(sums.values()) == pytest.approx(8000, rel=1e-6)
    with pytest.raises(ValueError):
        mixing.mix(df, targets={"source": {"a": 0.9, "b": 0.2}})


def test_mixing_repeats_and_dealt_cells(spark, docs, monkeypatch):
    one = mixing.mix(docs, 0.7).select("doc_id", "text", "probability", "kept_").collect()
    assert len({(r.probability, r.kept_) for r in one if r.doc_id == 5}) == 1
    monkeypatch.setattr(mixing, "ONE_TASK", 0)
    monkeypatch.setattr("docloom.session.BROADCAST_ROWS", -1)
    assert sorted(map(str, mixing.mix(docs, 0.7).select("doc_id", "text", "probability", "kept_").collect())) == sorted(map(str, one))


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[9].n_base, got[9].first_word, got[9].last_word, got[9].base_labels, got[9].score) == (2, 0, 3, "cc-by,mit", 1.0)
    assert got[3].n_words == 0 and got[3].first_word is None and licenses.scan_licenses(none).count() == 0


def test_licenses_bundles():
    rng = random.Random(5)
    index = licenses.Index(licenses.BASE, licenses.TEMPLATES)
    bodies = [text for _, text, _ in licenses.TEMPLATES]
    every = {label for label, _, _ in licenses.TEMPLATES}
    assert set(index.scan(licenses.license_words(" . ".join(bodies)))[1]) == every
    common = "are at can code file for it may not that any use with"
    ends = ["creative commons zero v1 0 universal", "gnu general public license version 3"]
    assert {"cc0", "gpl-3"} <= set(index.scan(licenses.license_words(" ".join([*bodies[:2], bodies[8], bodies[14], common, *ends])))[1])
    # one word more or less, and others within, in a whole text
    words = licenses.license_words(licenses.MIT)
    assert index.scan(words[:9] + [b"very"] + words[9:])[1]["mit"] == 1.0
    long = licenses.Index({}, [("mit", licenses.MIT, [])])
    assert long.scan([b"x"] * 50 + words[:60] + [b"a", b"b"] + words[61:120] + words[123:] + words)[1] == {"mit": 1.0}
    assert long.scan(words[:60] + [b"a", b"b"] + words[61:120] + words[123:])[1] == {"mit": (len(words) - 4) / len(words)}
    assert long.scan(words[::-1])[1] == {} and long.scan([w for w in words for _ in (0, 1)])[1] == {}


def plain_in_order(template, words, start, drift):
    """Longest common run in order, by all pairs of places that are near enough."""
    best = {}
    for q, w in enumerate(template):
        for p in range(max(0, start + q - drift), min(len(words), start + q + drift + 1)):
            if words[p] == w:
                best[q, p] = 1 + max((n for (a, b), n in best.items() if a < q and b < p), default=0)
    return max(best.values(), default=0)


def test_licenses_against_every_place(spark):
    rng = random.Random(6)
    short = [x for x in licenses.TEMPLATES if len(x[1].split()) < 30]
    index = licenses.Index(licenses.BASE, short)
    for _ in range(40):
        words = []
        for _, text, _ in rng.choices(short, k=rng.randint(1, 4)):
            for w in licenses.license_words(text):
                chance = rng.random()
                words += [] if chance < 0.08 else [b"x", w] if chance < 0.16 else [b"y"] if chance < 0.24 else [w]
        best = {}
        for label, text, keys in short:
            own, keys = licenses.license_words(text), [licenses.license_words(k) for k in keys]
            drift = max(2, len(own) // 10)
            for start in range(-len(own), len(words)):
                span = words[max(start - drift, 0) : max(start + len(own) + drift, 0)]
                if all(any(span[i : i + len(k)] == k for i in range(len(span))) for k in keys):
                    score = plain_in_order(own, words, start, drift) / len(own)
                    if score >= licenses.LEAST:
                        best[label] = max(best.get(label, 0.0), score)
        assert index.scan(words)[1] == best
    base = {}
    text = " ".join(rng.choice("gnu general public license apache mit cc by x".split()) for _ in range(3000))
    for phrase, label in licenses.BASE.items():
        for at in range(3000):
            if text.split()[at : at + len(phrase.split())] == phrase.split():
                base[at] = label
    assert index.scan(licenses.license_words(text))[0] == sorted(base.items()) and len(base) > 50


def test_chat(spark):
    said = r"</s>[INST] ok [/INST] \ <\| <<SYS>> <|im_end|>"
    rows = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(rows).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{said}\n" + f"assistant\n{said}\n" * 2) and got[1].loss_sha256 == sha(said * 2)
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0) and chat.chat_digests(rows.where("conv_id < 0")).count() == 0
    clash = spark.createDataFrame([(None, 0, "user", LONG), (None, 1, "assistant", LONG), (3, 0, "user", "")], "conv_id long, turn long, role string, text string")
    for c in ("piece", "flat", "parts", "place", "at", "rows"):
        clash = clash.withColumn(c, F.lit("x"))
    got = {r.conv_id: r for r in chat.chat_digests(clash).collect()}
    assert got[None].turns_sha256 == sha(f"user\n{LONG}\nassistant\n{LONG}\n") and got[None].loss_chars == len(LONG) and got[3].n_turns == 1
    part = "struct(kind, cast(null as string) text, ref, 57L width, 28L height, 2D seconds, 3L pages)"
    parts = spark.createDataFrame([("image", "i"), ("audio", "a"), ("document", "d")], "kind string, ref string").selectExpr(f"{part} p").groupBy().agg(F.array_sort(F.collect_list("p")).alias("parts"))
    out = chat.format_chats(parts.selectExpr("1L conv_id", "0L turn", "'user' role", "parts")).first()
    assert [(a.kind, a.tokens) for a in out.attachments] == [("audio", 50), ("document", 1536), ("image", 3)]
    assert all(out.formatted[a.start :].startswith(f"<|{a.kind}|>") for a in out.attachments)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 0), (9, None)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).count() == len(ROWS)
    assert quality.score_quality(docs, labels.where("doc_id < 0")).where("NOT good").count() == 0
    assert quality.score_quality(none, labels).count() == 0
    got = quality.score_quality(docs, labels).collect()
    assert {str((r.evidence, r.site, r.quality_)) for r in got if r.doc_id == 5}.__len__() == 1 and all(0 <= r.quality_ <= 1 and r.quality == "x" for r in got)
    # a repeated labelled id with two texts gives the same model in any order
    twice = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.lit("0 ! ! ! !")))
    one, two = (sorted((str(r.doc_id), r.evidence) for r in quality.score_quality(df, labels).collect()) for df in (twice, twice.repartition(7)))
    assert one == two


def test_quality_of_sites_by_url(spark):
    """Documents of equal texts differ by what the rest of their path is like; a path of one goes by its host."""
    good, bad = "Plain words of some length, all fine here.", "!!!! $$$$ #### !!!!"
    rows = [(i, good if i % 2 else bad, f"http://{'a' if i % 2 else 'b'}.x/p/{i}") for i in range(40)] + [(100, "some text, 12!", "http://a.x/p/z"), (101, "some text, 12!", "http://b.x/p/z"), (102, "some text, 12!", None), (103, "some text, 12!", "http://a.x/q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(df, labels).collect()}
    assert got[100].evidence == got[101].evidence == got[102].evidence and got[100].quality > got[102].quality > got[101].quality
    assert got[103].site == got[103].host_site > got[101].host_site


def test_media(docs, none):
    got = media.document_media(docs).collect()
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    for r in got:
        payload = media.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and (r.columns, r.rows) == (576, len(payload) // 576)
    assert len(got) == len(ROWS) and media.document_media(none).count() == 0


def plain_png(payload):
    """Lines of a grey PNG by the standard library."""
    lines = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
    parts = [(b"IHDR", struct.pack(">IIBBBBB", 576, len(payload) // 576, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 6)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def test_media_is_stored_once_and_rows_point_to_it(spark):
    texts = ["one text " * 90, "another", None, ""]
    rows = [(i, texts[i % 4]) for i in range(80)] + [(None, "one text " * 90), (3, "of its own"), (3, "of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"payload": F.lit(1), "shard": F.lit("x"), "n_bytes": F.lit(2)}).repartition(4)
    out = media.document_media(df)
    assert out.count() == 83  # an action more writes nothing more
    got = out.collect()
    assert sorted(Counter((r.doc_id, r.payload_sha256) for r in got).values()) == sorted(Counter((i, hashlib.sha256(media.pad((t or "").encode())).hexdigest()) for i, t in rows).values())
    folder = Path(got[0].shard.removeprefix("file://").removeprefix("file:")).parent
    members = [name for tar in folder.glob("*.tar") for name in media.tar_members(tar.read_bytes())]
    assert sorted(set(members)) == sorted({f"{r.media_sha256[:2]}/{r.media_sha256}.png" for r in got}) and 4 <= len(members) <= 5
    assert len({(r.shard, r.offset) for r in got}) == 4
    for r in got:
        stored = Path(r.shard.removeprefix("file://").removeprefix("file:")).read_bytes()[r.offset : r.offset + r.media_bytes]
        payload = media.decode_png(stored)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and hashlib.sha256(payload).hexdigest() == r.payload_sha256
        assert stored == plain_png(payload)
        mean = sum(payload) / len(payload)
        edges = [i * len(payload) // 64 for i in range(65)]
        bits = "".join("1" if sum(payload[a:b]) * len(payload) >= sum(payload) * (b - a) else "0" for a, b in zip(edges, edges[1:]))
        assert r.feature == f"mean={mean:.4f};var={sum((x - mean) ** 2 for x in payload) / len(payload):.4f};ahash={int(bits, 2):016x}"


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in got) and all(r.size == len((dict((a, b) for a, b, *_ in ROWS)[r.doc_id] or "").encode()) + 16 for r in got)
    many = sharding.shard_documents(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).collect()
    for s in range(40):
        slots = sorted(r.slot for r in many if r.shard == s)
        assert slots == list(range(len(slots))) and 350 < len(slots) < 650
    assert 350 < sum(r.grown_shard == 40 for r in many) < 650 and sharding.shard_documents(none).count() == 0
    whole = sharding.shard_documents(docs, keep=True)
    assert whole.columns[: len(docs.columns)] == docs.columns and whole.columns[len(docs.columns) :] == ["size", "text_crc32", "law", "shard", "slot_", "grown_shard"]
    assert sorted(map(str, whole.select("doc_id", "size", "shard", F.col("slot_").alias("slot")).collect())) == sorted(map(str, sharding.shard_documents(docs).select("doc_id", "size", "shard", "slot").collect()))


def test_sharding_grows_inside_a_rack(spark):
    """A shard more in a rack takes rows, in that rack's region and rack, and rows move only into subtrees whose weight rose."""
    tree = sharding.even_tree(16)
    more = [*tree, (tree[0][0], tree[0][1], 99, 1.0)]
    at = {leaf[2]: leaf[:2] for leaf in more}
    rows = spark.range(20_000).select(sharding.tree_shard(F.col("id"), tree).alias("a"), sharding.tree_shard(F.col("id"), more).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert 800 < sum(r.b == 99 for r in rows) < 1600 and len(moved) < 5000
    for a, b in moved:
        # into the region, or within it into the rack, or within that into the shard
        assert at[b][0] == tree[0][0] and (at[a][0] != at[b][0] or at[b] == at[99] and (at[a] != at[b] or b == 99))
