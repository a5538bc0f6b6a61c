"""Findings of round 3: what each asked for, at small size."""

import tracemalloc

import pyarrow as pa

from docloom.operators import segment


def test_segments_of_a_batch_hold_few_python_objects():
    """32 MB of texts with nulls, empty ones and one longer than a slice: the rows' own segments, while few texts are Python objects at once."""
    few = ["# A\n" + "x" * 2_000 + "\n## B\ny", None, "", "# only", "z" * 3_000_000]
    texts = pa.array((few + ["# C\n" + "w" * 4_000] * 200) * 8, pa.string())
    kind = pa.array(["text/markdown"] * len(texts))
    tracemalloc.start()
    got = segment.segment.func(texts, kind)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 30_000_000 and peak < 20_000_000
    want = [[{"text": t, "breadcrumb": c} for t, c in segment.markdown_segments(x)] for x in texts.to_pylist()[:300]]
    assert got.slice(0, 300).to_pylist() == want and len(got) == len(texts)


def test_html_metadata_equals_its_sql_on_other_references(spark, tmp_path):
    import duckdb

    from docloom.plans import queries

    titles = ["A &amp; B", "a &quot;b&quot; &lt;", "cut &&amp;&amp", "&amp;amp; &AMP; &#38; &eacute", "plain"]
    rows = [(i, f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = set(db.sql(queries.ORACLE_SQL["html_metadata"]).fetchall())
    assert {tuple(r) for r in queries.html_metadata(spark, str(tmp_path)).collect()} == want and len(want) == 5


def test_watched_pages_are_few_files(spark, tmp_path, monkeypatch):
    """300 pages, line ends in them, in no more files than tasks wrote; each page is met once and by its own path."""
    from docloom.plans import more_queries

    monkeypatch.setattr(more_queries, "new_path", lambda _, name: f"file://{tmp_path}/{name}")
    spark.createDataFrame([(i, f"<p>{i}</p>\r\n<p>\n</p>") for i in range(300)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = more_queries.watched_pages(spark, str(tmp_path)).collect()
    assert len(list((tmp_path / "box").rglob("*.json"))) <= 16 and len(rows) == len({r.path for r in rows}) == 300
    assert {(r.ok, r.reason) for r in rows} == {(True, None), (False, "unsupported extension '.exe'"), (False, "document is empty")}


class _OneValue:
    """A key's state that counts how often it is put."""

    exists, hasTimedOut, get, puts, ends = False, False, None, 0, None  # noqa: N815

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.now

    def update(self, value):
        self.exists, self.get, self.puts = True, value, self.puts + 1

    def setTimeoutTimestamp(self, at):  # noqa: N802
        self.ends = at


def test_a_key_goes_through_one_state_value():
    """Items wait in the key's one value until the watermark passes them, and the timeout tells when that will be."""
    import pandas as pd

    from docloom.streaming.stateful import Batcher

    state, made = _OneValue(), Batcher("k", 2, 100, True)
    state.now = 0
    assert [len(f) for f in made(("a",), iter([pd.DataFrame({"item": [3, 1, 2], "at": [30, 10, 20]})]), state)] == [0]
    assert state.puts == 1 and state.ends == 10
    state.now, state.hasTimedOut = 31, True
    (out,) = made(("a",), iter([]), state)
    assert out.values.tolist() == [["a", 0, 2, 1, 2]] and state.puts == 2 and state.ends == 129
    state.now = 130
    (out,) = made(("a",), iter([]), state)
    assert out.values.tolist() == [["a", 1, 1, 3, 3]]


def test_terms_and_heads_cost_no_more_than_they_need(spark):
    """Terms are those of the pattern whatever letters stand around them; lines beyond the head are not split."""
    import re
    import zlib

    from pyspark.sql import functions as F

    from docloom.operators.chunking import _codes, term_codes

    texts = ["Ab-9 éa xK İi", "", "ÿz\x00q\n__ 漢x字y \U0001f600k"]
    row, code = term_codes(texts)
    want = [(i, zlib.crc32(w.encode())) for i, t in enumerate(texts) for w in re.findall("[a-z0-9]+", t.lower())]
    assert list(zip(row.tolist(), code.tolist())) == want and all(isinstance(w, bytes) for w in _codes)
    lines = "x\n" * 39 + "title: last\n" + "y\n" * 100 + "version: 9\n"
    made = segment.metadata(spark.createDataFrame([(lines,)], "text string").withColumn("mime_type", F.lit("text/plain")))
    assert made.select("version", "title").first() == ("1", "last")
    assert f", {segment.HEAD_LINES + 1})" in made._jdf.queryExecution().analyzed().toString()


def test_sums_of_buckets_come_together_one_at_a_time():
    import numpy as np

    from docloom.llm.pitman_yor import _plus

    parts = [(np.array(k, np.uint64), np.array(v, float), np.array(v, float) * 2) for k, v in (([1, 5, 9], [1, 2, 3]), ([2, 5], [10, 20]), ([9], [100]))]
    total = None
    for part in parts:
        total = _plus(total, part)
    assert total[0].tolist() == [1, 2, 5, 9] and total[1].tolist() == [1, 10, 22, 103] and total[2].tolist() == [2, 20, 44, 206]
