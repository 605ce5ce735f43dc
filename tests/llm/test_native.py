"""Operators on DataFrames only: exact dedup, quality rules, mixing, preference formatting."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, exact_dedup, mixing, quality_rules, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sql(spark):
    from tests.oracle import connect, differences

    duck = connect(SF)
    for name, sql in queries.oracle_sql().items():
        extra, missing = differences(queries.queries()[name](spark, SF), sql, duck)
        assert not extra and not missing, (name, extra[:2], missing[:2])


# exact dedup

EDGE = [(5, "a  b", "x"), (3, "a\tb", "y"), (9, None, None), (8, "", "x"), (7, "A b", "x"), (4, " a b", "x")]


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("files", [1, 1000])
def test_exact_duplicates(spark, short, files):
    """A digest of four values makes every row a hit that only the byte check can tell apart."""
    options = {"digest": lambda t: F.pmod(F.xxhash64(t), F.lit(4)).cast("string").cast("binary")} if short else {}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs(spark, *EDGE), files_per_trigger=files, **options).collect()}
    assert got == {3: (3, 2, True), 5: (3, 2, False), 8: (8, 2, True), 9: (8, 2, False), 7: (7, 1, True), 4: (4, 1, True)}


def test_deduplicated_rows(spark):
    d = docs(spark, (1, "x", "s"), (1, "x", "s"), (2, "x", "s"), (None, "y", "s"), (None, "y", "s"), (None, "z", "s")).withColumn("keep_id", F.lit(7)).withColumn("digest", F.lit("d"))
    out = exact_dedup.deduplicated(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "y"), (0, "z"), (1, "x")]
    five = docs(spark, (0, "x", "s"), (1, "x", "s"), (1, "only here", "s"), (2, "a  b", "s"), (2, "a b", "s"))
    short = lambda t: F.pmod(F.xxhash64(t), F.lit(2)).cast("string").cast("binary")
    for options in ({}, {"digest": short}):
        assert sorted((r.doc_id, " ".join(r.text.split())) for r in exact_dedup.deduplicated(five, **options).collect()) == [(0, "x"), (1, "only here"), (2, "a b")]


@pytest.mark.parametrize("short", [False, True])
def test_state_outlives_the_call(spark, tmp_path, short):
    options = {"digest": lambda t: F.pmod(F.xxhash64(t), F.lit(2)).cast("string").cast("binary")} if short else {}
    for name, some in (("one", [(5, "a b", "s"), (6, "c", "s"), (8, "d", "s")]), ("two", [(7, "a  b", "s"), (3, "c", "s"), (9, "e", "s"), (10, "e", "s")])):
        docs(spark, *some).write.parquet(str(tmp_path / name))
    run = lambda name: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark.read.parquet(str(tmp_path / name)), state_path=str(tmp_path / "state"), **options).collect()}
    assert run("one") == {5: (5, 1, True), 6: (6, 1, True), 8: (8, 1, True)}
    assert run("two") == {7: (5, 2, False), 3: (3, 2, True), 9: (9, 2, True), 10: (9, 2, False)}


def test_rules_and_mix_of_repeated_ids(spark):
    line = "the same line with many words in it for all of us"
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(i, line, "h") for i in range(7)] + [(9, line + "\n" + other, "h"), (9, other, "h"), (9, other, "h")]
    got = sorted((r.doc_id, r.n_words, r.removed_words, r.kept) for r in quality_rules.apply_rules(docs(spark, *rows), max_docs=5).collect() if r.doc_id == 9)
    assert got == [(9, 40, 0, True), (9, 40, 0, True), (9, 52, 12, True)]
    assert [(r.doc_id, r.text) for r in quality_rules.cleaned(docs(spark, *rows), max_docs=5).collect()] == [(9, other)] * 2
    mixed = mixing.mixed_documents(docs(spark, (1, "a b", "s"), (1, "c d", "s"), (None, "e f", "s")).withColumn("__n", F.lit("n")), share=1.0)
    assert sorted((r.doc_id or 0, r.text, r["__n"]) for r in mixed.collect()) == [(0, "e f", "n"), (1, "a b", "n"), (1, "c d", "n")]


def test_exact_empty(spark):
    empty = docs(spark, (1, "x", "s")).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_exact_hot_group(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = exact_dedup.exact_duplicates(d)
    assert got.where("not kept").count() == 999 and got.where("keep_id = 0").count() == 1000


# quality rules


def plain_repeats(text):
    w = words(text)
    at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for k in range(5)})


def test_repeat_words(spark, table):
    texts = [r.text for r in table.select("text").collect()] + ["a b c d e a b c d e", "a a a a a a a", "a b c d", "", None, "x " * 9 + "y"]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.apply_rules(d).collect()}
    assert got == {i: (len(words(t)), plain_repeats(t)) for i, t in enumerate(texts)}


def test_frequent_lines(spark):
    common = "this line stands in very many documents of one host"
    own = [f"own words of document {i} " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(12)]
    rows = [(i, f"{common}\n{own[i]}", "h") for i in range(6)] + [(6, f"  THIS line  stands in very many documents of one host\n{common}", "h"), (7, f"{common}\n{own[7]}", "other"), (8, f"{common}\n{own[8]}", None)]
    got = {r.doc_id: (r.removed_words, r.kept) for r in quality_rules.apply_rules(docs(spark, *rows), max_docs=5).collect()}
    assert got == {**{i: (10, True) for i in range(6)}, 6: (20, False), 7: (0, True), 8: (0, True)}
    cleaned = {r.doc_id: r.text for r in quality_rules.cleaned(docs(spark, *rows), max_docs=5).collect()}
    assert cleaned[0] == own[0] and cleaned[7] == rows[7][1] and 6 not in cleaned


def test_frequent_lines_by_shuffle(spark, monkeypatch):
    rows = [(i, "the same line with many words in it for all of us\n" + " ".join(f"v{i}y{k}" for k in range(30)), "h") for i in range(9)]
    want = sorted(map(tuple, quality_rules.apply_rules(docs(spark, *rows), max_docs=5).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", -1)
    assert sorted(map(tuple, quality_rules.apply_rules(docs(spark, *rows), max_docs=5).collect())) == want


def test_rules_edges(spark):
    got = {r.doc_id: tuple(r) for r in quality_rules.apply_rules(docs(spark, (1, None, None), (2, "#a $b", "s"), (3, "x\nx\n \nx", "s")).withColumn("kept", F.lit(1))).collect()}
    assert got[1][1:6] == (0, 0, 0, 0, 0) and got[1][-3:-1] == (True, False)
    assert got[2][1:4] == (2, 4, 2) and got[3][4] == 2
    assert quality_rules.apply_rules(docs(spark, (1, "x", "s")).limit(0)).count() == 0


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / weight > most * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / weight for s in free}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("ranges", [3, 2000])
def test_mix(spark, table, ranges):
    d = table.unionByName(docs(spark, (900001, None, None), (900002, "one two three", None), (900003, "", "src3")))
    sizes = defaultdict(int)
    source = {}
    for r in d.collect():
        sizes[r.source] += len(words(r.text))
        source[r.doc_id] = r.source, len(words(r.text))
    want = plain_targets(sizes)
    got = mixing.mix(d, rows_per_range=ranges).collect()
    taken = defaultdict(int)
    for r in got:
        s, n = source[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    assert len(got) == len(source) and all(abs(taken[s] - want[s]) < 1.001 for s in want)
    again = {r.doc_id: r.taken for r in mixing.mix(d.repartition(7), rows_per_range=ranges).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mixed_documents(spark, table):
    plan = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(table, boundary="whole").collect()}
    out = mixing.mixed_documents(table.withColumn("size", F.lit(1)))
    assert out.columns == [*table.columns, "size"]
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({i: n for i, n in plan.items() if n})


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, (1, "x", "s")).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, (1, "", "s"), (2, None, None))).collect()] == [0, 0]
    one = mixing.mix(docs(spark, (1, "a b c", "s"))).first()
    assert (one.target, one.taken) == (4.5, 4)
    same = mixing.mix(docs(spark, (1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")))
    assert sum(r.taken for r in same.collect()) == 7


# preference formatting


def test_preference(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (4, 0, "user", "<|im_end|>"), (5, 0, "user", "<|im_end|>"), (None, 0, "user", "lost")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    got = {r.pair_id: r for r in chat_format.paired_by_id(d).collect()}
    r = got[0]
    assert r.n_prompt_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert r.chosen == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    a, b = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:b] == "yes<|im_end|>"
    assert got[1].prompt == "" and got[1].rejected is None and got[1].chosen == "<|im_start|>unknown\n<|im_end|>\n" and got[1].chosen_mask == ""
    assert got[2].n_prompt_turns == 1 and got[2].chosen == got[2].rejected == "" and got[2].prompt.count("<|im_end|>") == 1
    assert set(got) == {0, 1, 2}
    assert chat_format.paired_by_id(d.limit(0)).count() == 0
