"""Operators 11 to 13 against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import infill, packing, resample
from docloom.session import table

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)) + " " + "q" * 40_000
ROWS = [
    (1, "Some words here, and MORE words: " * 9), (2, None), (3, ""), (4, "  \t "), (5, "Zwölf Boxkämpfer\x85jagen\x1cViktor  quer　über\n\nden großen Sylter Deich. " * 3), (5, "two"), (5, "two"),
    (None, "no key but twenty words " * 6), (7, LONG), (8, "a <P> b <S> c"), (9, "ends in white \n"), (10, "\x1e\x10d\x10e \x1e\x1e \x10"), (11, "日本語 \U0001f642\U0001f642 <|endoftext|> é"), (12, "same " * 30), (13, "same " * 30), (13, "same " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("n", "form", "prefix", "output", "_h", "rank", "score", "words", "fit", "part", "nth", "place", "_text", "_key", "piece", "length", "key", "bucket")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def draws(doc_id, n):
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(n)]


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = draws(doc_id, 4)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, len(units), form, *sizes, sha(out), sha(text))


def test_infill(docs, none):
    got = [tuple(r) for r in infill.infill_digests(docs).collect()]
    assert sorted(got, key=str) == sorted((plain_infill(*r) for r in ROWS), key=str)
    assert infill.infill_digests(none).count() == 0
    whole = infill.fill_in_middle(docs)
    assert whole.columns[: len(docs.columns)] == docs.columns and {"n_", "form_", "prefix_", "output_"} <= set(whole.columns)


def test_infill_of_many_texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "bc", " ", "\n", "\x1e", "\x10", "d", "e", "<", "S", "P>", "é", "\x85", "\U0001f642", "\x0b\x0c"]) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    got = {r[0]: tuple(r) for r in infill.infill_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_infill(i, t) for i, t in rows} and len({r[2] for r in got.values()}) == 3


def test_infill_with_other_marks_and_shares(spark):
    rows = spark.createDataFrame([(i, f"one two {i} three four") for i in range(50)], "k long, body string")
    marks = ("[pre]", "[suffix]", "[mid]")
    made = infill.fill_in_middle(rows, percent=100, spm_percent=30, marks=marks, key="k", text="body")
    back = made.withColumn("back", infill.restore(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.body and r.prefix + r.middle + r.suffix == r.body for r in back) and Counter(r.form for r in back).keys() == {"psm", "spm"}


def plain_grams(text, longest=3):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resample(rows, target):
    s, t = (Counter(b for text in texts for b in plain_grams(text)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        words, found = plain_grams(text)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((draws(doc_id, 1)[0] + 0.5) / 4294967296))), len(words) >= 20))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = len(fit) * 5 // 100
    return sorted(((*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)), key=str) + sorted(((*r[:4], None) for r in out if not r[4]), key=str)


def test_resample(docs, none, spark):
    target = spark.createDataFrame([("same same words here",), (None,), ("",)], "text string")
    many = docs.select("doc_id", "text", "rank", "place", "words").unionByName(spark.range(60).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("some words " * 12), F.col("id").cast("string")).alias("text"), *[F.lit("x").alias(c) for c in ("rank", "place", "words")]))
    rows = [(r.doc_id, r.text) for r in many.collect()]
    got = resample.resample(many, target, carry=["rank", "words"])
    assert got.columns == ["doc_id", "rank", "words", "n_features", "weight", "score", "rank_"]
    found = [(r.doc_id, r.n_features, r.weight, r.score, r.rank_) for r in got.collect()]
    assert sorted(found, key=str) == sorted(plain_resample(rows, ["same same words here"]), key=str)
    assert sum(r[4] is not None for r in found) == 3
    assert resample.resample(none, target).count() == 0
    assert resample.resample(docs, target.where("false")).count() == len(ROWS)


def test_resample_of_repeated_rows(spark):
    """Rows equal in all columns, a third of the table and more, get ranks of their own."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") + 10).alias("doc_id"), F.lit("word " * 25).alias("text"))
    ranks = [r.rank for r in resample.resample(rows, rows).collect() if r.rank]
    assert sorted(ranks) == list(range(1, 46))


def test_word_bytes_of_pieces_and_long_words(monkeypatch):
    import pyarrow as pa

    from docloom.llm import words

    rng = random.Random(2)
    texts = ["".join(rng.choice(["A", "b9", " ", "-", "é", "日", "\x00", "x" * 300]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["y" * 5000 + " z"]
    for piece in (50, 1 << 20):
        monkeypatch.setattr(words, "PIECE", piece)
        for first, data, offsets in words.pieces(pa.array(texts)):
            rows, found, n = resample.features(data, offsets)
            for r in range(len(offsets) - 1):
                said, expected = plain_grams(texts[first + r])
                assert sorted(found[rows == r].tolist()) == sorted(expected) and n[r] == len(said)


def byte_bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def check_packed(rows, expected):
    """Every piece of the plain tokenizer's ids is there, and sequences are gapless and not too long."""
    want = Counter()
    for key, ids in expected:
        first = (len(ids) - 1) % 1024 + 1
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[key, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return held


def test_packing(docs, none, spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(byte_bpe())
    expected = [(k, [*own.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in ROWS]
    packed = packing.pack_documents(docs, byte_bpe(), ids=True)
    check_packed(packed.collect(), expected)
    said = Counter(i for _, ids in expected for i in ids)
    whole = packing.sequences(packed).collect()
    assert Counter(i for r in whole for i in r.ids) == said and all(len(r.ids) <= 1024 for r in whole)
    assert packing.pack_documents(none, byte_bpe()).count() == 0


def test_packing_of_documents(spark):
    """All documents of the smallest table, by the plain tokenizer; few more sequences than their tokens need."""
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(byte_bpe())
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    expected = [(r.doc_id, [*own.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    held = check_packed(packing.pack_documents(docs, byte_bpe()).collect(), expected)
    assert len(held) <= 1.01 * sum(len(i) for _, i in expected) / 1024 + 1


def test_any_tokenizer():
    """A tokenizer of another kind is run as it is; a byte-level one gives what it gives by itself."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rng = random.Random(4)
    texts = ["".join(rng.choice([*"ab'st .,!!==--aa00\n\t\r\x0b\x1c", "é", "日", "　", " ", "\u0085", "\U0001f642", "<|endoftext|>", "ing", " the"]) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own, mine = tokenizers.Tokenizer.from_file(public.path(name)), packing.tokenizer(public.path(name))
        assert all(own.encode(t, add_special_tokens=False).ids == list(mine(t)) for t in texts)


def plain_best_two_fit(counts, capacity, swap):
    left, out = Counter(counts), []
    while +left:
        gap, used = capacity, Counter()
        while fits := [s for s in left if left[s] > used[s] and s <= gap]:
            used[max(fits)] += 1
            gap -= max(fits)
        if gap and swap:
            least = min(+used)
            free = [s for s in left if left[s] > used[s]]
            pairs = [(a + b, a, b) for a in free for b in free if b <= a and least < a + b <= gap + least and (a != b or left[a] - used[a] > 1)]
            if pairs:
                used -= Counter([least])
                used += Counter(max(pairs)[1:])
        left -= used
        out.append(sorted((+used).items(), reverse=True))
    return out


def test_best_two_fit():
    """In bulk and one by one, the same sequences in the same order; every piece has its place."""
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([10, 16, 33])
        counts = {s: rng.randint(0, 9) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        for swap in (True, False):
            plan = packing.best_two_fit(counts, capacity, swap)
            assert [used for times, used in plan for _ in range(times)] == plain_best_two_fit(counts, capacity, swap)
        best = packing.fewest(counts, capacity)
        assert sum(t for t, _ in best) == min(len(plain_best_two_fit(counts, capacity, s)) for s in (True, False))
        taken = Counter()
        for times, used in best:
            taken += Counter({s: times * n for s, n in used})
        assert taken == +Counter(counts)
