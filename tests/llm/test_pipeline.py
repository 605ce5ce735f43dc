"""The pipeline's stages, each against a plain version on its own input."""

import pytest

import corpus_pipeline
from tidemark.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
        out.append((name, docs))
    return out


def test_stages(spark, kept):
    names = [n for n, _ in kept]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "source mix", "sentencepiece encoding"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == columns for _, df in kept[:4])


def test_copies_go_and_nothing_else(kept):
    before, after = ([r for r in df.collect()] for _, df in kept[:2])
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(" ".join((r.text or "").replace("\n", " ").split(" ")), r.doc_id)
    assert {r.doc_id for r in after} == set(first.values())


def test_near_copies_only(kept):
    before, after = ({r.doc_id: r.text for r in df.collect()} for _, df in kept[1:3])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    left = {i: shingles(t) for i, t in after.items()}
    for i in set(before) - set(after):
        s = shingles(before[i])
        assert max(len(s & x) / len(s | x) for x in left.values()) > 0.6


def test_encoding_has_every_row_of_the_mix(kept):
    mixed, encoded = kept[3][1], kept[4][1]
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == sorted(r.doc_id for r in encoded.select("doc_id").collect())
    assert all(r.n_tokens == len(r.ids) for r in encoded.collect())


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, SF).count() == kept[-1][1].count()


def test_stages_on_odd_rows(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns with names the stages use."""
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, long + " end", "en", "t", 1), (None, "no id at all", None, "s", 2), (None, None, None, None, None), (5, "a b c", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("gone", "kept", "keep_id", "group_id", "fp", "node", "key", "size", "taken", "salt", "grade", "ids", "tail_probability"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, empty, SF)
        assert none.count() == 0, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name != "sentencepiece encoding":
            assert out.columns == docs.columns, name
        if name == "exact dedup":
            assert sorted(ids, key=str) == sorted([1, 3, 4, 5, None], key=str)
        if name == "simhash near-dedup":
            assert 4 not in ids and {1, 3, 5, None} <= set(ids)
        if name == "sentencepiece encoding":
            assert len(ids) == len(rows)


def test_rows_that_repeat_an_id_are_not_lost(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(0, text(0)), (1, text(0) + " more"), (1, text(1)), (2, text(2)), (2, text(2))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        got = sorted(r.text for r in stage(spark, docs, SF).collect())
        want = sorted([text(1), text(2)]) if name == "simhash near-dedup" else None
        assert want is None or (set(want) <= set(got) and len(got) == 3)
        assert want or {t for _, t in rows} == set(got)
