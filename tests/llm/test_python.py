"""Operators that run Python on the executors, against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import attention, lm_scoring, piece_codec, quality_classifier, queries, simhash, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


# substring dedup

LONG = " ".join(f"word{k}" for k in range(60))


def test_substring(spark):
    d = docs(spark, (2, f"intro two\n{LONG}\nend"), (1, f"{LONG.upper()}  \nshort\nshort"), (3, f"a\n{LONG}\n{LONG}"), (4, None), (5, ""), (6, "short\nshort"))
    got = {r.doc_id: r for r in substring_dedup.without_repeats(d.withColumn("spans", F.lit(1))).collect()}
    assert got[1].n_removed == 0 and got[1].text.endswith("short\nshort")
    assert got[2].text == "intro two\nend" and got[2].spans == f"10-{11 + len(LONG)}"
    assert got[3].text == "a\n" and got[3].n_removed == 2
    assert (got[4].text, got[5].text, got[6].n_removed) == ("", "", 0)


def test_substring_paragraphs_and_batches(spark, monkeypatch):
    d = docs(spark, (1, f"{LONG}\nmore\n\nx"), (2, f"y\n \n{LONG} more"), (None, f"{LONG}\nmore"))
    for at_once in (1, 200_000):
        monkeypatch.setattr(substring_dedup, "AT_ONCE", at_once)
        got = {r.doc_id: r.text for r in substring_dedup.without_repeats(d, unit="paragraph").collect()}
        assert got == {1: f"{LONG}\nmore\n\nx", 2: "y\n \n", None: ""}
    assert substring_dedup.without_repeats(d.limit(0)).count() == 0


def test_substring_passage_inside_lines(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve thirteen! " + " ".join(f"w{k}" for k in range(20)) + "."
    d = docs(spark, (1, f"start here {passage} Then more.\nx"), (2, f"Other words. {passage} No end"), (3, "Then more. One two three four five six. Nothing."), (4, "a. " * 90))
    got = {r.doc_id: r for r in substring_dedup.without_repeats(d).collect()}
    assert got[2].text == "Other words. One two three four five six. No end" and got[2].n_removed == 2  # the first sentence differs in doc 1
    assert got[1].n_removed == got[3].n_removed == got[4].n_removed == 0  # short runs and one-word units don't count


def test_substring_very_long_text(spark):
    long = "\n".join(f"line {k} of a very long text with enough words" for k in range(60_000))
    got = {r.doc_id: r for r in substring_dedup.without_repeats(docs(spark, (1, long), (2, "z\n" + long), (3, "w" * 3_000_000))).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 60_000 and got[2].text == "z\n" and len(got[3].text) == 3_000_000


def test_substring_repeated_rows(spark):
    got = substring_dedup.without_repeats(docs(spark, (1, LONG), (1, LONG), (2, LONG), (2, LONG + " x"), (3, LONG), (3, LONG), (3, "y"))).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, LONG), (1, LONG), (2, ""), (2, LONG + " x"), (3, ""), (3, ""), (3, "y")]


# quality classifier


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 6000")
    graded = quality_classifier.grades(spark.read.parquet(f"{sf}/labels.parquet")).join(d.select("doc_id"), "doc_id")
    test = graded.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    model = quality_classifier.train(d, graded.join(test, "doc_id", "left_anti"))
    assert len(model.grades) == 3 and (np.diff(model.thresholds) > 0).all()
    got = quality_classifier.scored(d, model, wanted=2).join(test, "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("g")).collect()
    kept, mean = {r.grade: r.kept for r in got}, {r.grade: r.g for r in got}
    assert kept[2] > 0.97 and kept[1] < 0.2 and kept[0] < 0.35 and mean[0] < mean[1] < mean[2]


def test_classifier_fit_orders_thresholds():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 600)
    rows = [np.unique(np.concatenate(([10 + v], rng.integers(100, 160, 5)))).astype(np.uint32) for v in y]
    m = quality_classifier.fit(rows, y.astype(float))
    s = np.array([m.score(r) for r in rows])
    assert (np.diff(m.thresholds) > 0).all() and np.corrcoef(m.expected(s), y)[0, 1] > 0.9
    t = m.tails(s)
    assert (t[:, :-1] >= t[:, 1:]).all()
    assert np.allclose(m.tail(s, 0), 1) and np.allclose(m.tail(s, 9), 0) and np.allclose(m.tail(s, 2), t[:, 1])


def test_classifier_edges(spark):
    d = docs(spark, (1, None), (2, "x " * 20000), (3, "y")).withColumn("kept", F.lit(0))
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert quality_classifier.train(d, none) is None
    assert all(r.kept and r.expected_grade is None for r in quality_classifier.scored(d, None, 2).collect())
    one = spark.createDataFrame([(1, 2), (None, 1), (2, None)], "doc_id long, grade int")
    assert quality_classifier.train(d, one) is None
    two = spark.createDataFrame([(1, 2), (1, 0), (2, 1), (7, 1)], "doc_id long, grade int")
    m = quality_classifier.train(d, two)
    assert m.grades == [0.0, 1.0] and quality_classifier.scored(d, m, 1).count() == 3
    out = quality_classifier.accepted(d, m, 1, least=0.0)
    assert out.columns == d.columns and out.count() == 3
    assert quality_classifier.scored(d.limit(0), m, 1).count() == 0


# LM scoring


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def test_lm_scores(spark, table):
    d = table.select("doc_id", "text").unionByName(docs(spark, (10**6, None), (10**6 + 1, "ÀB ▁x \x1c word"))).withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in lm_scoring.score_documents(d, queries.piece_model()).collect()}
    texts = {r.doc_id: lower(r.text) + [b"\0end"] for r in d.select("doc_id", "text").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, ws in texts.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
        assert math.isfinite(r.mixed_score) and r.mixed_score < 0
    assert lm_scoring.score_documents(d.limit(0), queries.piece_model()).count() == 0


def test_lm_held_out_score(spark):
    """With 8,000 training texts the attention model predicts the others better than the base, whose one slot for all
    words that training lacks costs it nothing; mixed with the base it predicts them better still."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = lm_scoring.score_documents(d, queries.piece_model()).where("held_out").agg(*[F.sum(c).alias(c) for c in ("base_score", "score", "mixed_score")]).first()
    assert r.base_score < r.score < r.mixed_score


def test_lm_score_is_the_attention_model(spark, monkeypatch):
    """score and mixed_score word by word in plain loops, with a model whose attention scores are far apart."""
    made = []

    def random_model(model, batches, rounds, begin_id):
        rng = np.random.default_rng(4)
        w = {name: x.copy() for name, x in model.weights.items()}
        w["out"], w["query"] = rng.normal(0, 1, w["out"].shape).astype(np.float32), (w["query"] * 60).astype(np.float32)
        w["lag"] = np.linspace(-200, -90, len(w["lag"])).astype(np.float32)  # exp of each is zero unless shifted
        made.append(attention.Attention(model.classes, model.starts, model.within, model.bigram, w))
        return made[-1]

    monkeypatch.setattr(lm_scoring, "trained", random_model)
    texts = {k: " ".join(f"w{k % 3}{j % 7} Then{j}" for j in range(k)) for k in range(12)} | {50: "x" * 200 + " y", 51: None}
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs(spark, *texts.items()), queries.piece_model()).collect()}
    pieces = lm_scoring.tokenizer(open(queries.piece_model(), "rb").read())
    m, block, width = made[0], attention.BLOCK, attention.WIDTH
    w = {k: v.astype(float) for k, v in m.weights.items()}
    counts = Counter(x for i, t in texts.items() if not lm_scoring.held_out(i) for x in [*lower(t), b"\0"])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words = [pieces.encode(x.decode()) for x in lower(t)] + [[pieces.eos_id()]]
        stream = [x for word in words for x in word]
        inputs = [pieces.bos_id(), *stream[:-1]]
        logp, begins = [], []
        for p, target in enumerate(stream):
            seen = range(max(0, (p // block - 1) * block), p + 1)
            x = w["embed"][[inputs[q] for q in seen]]
            a = x @ w["key"] @ (w["embed"][inputs[p]] @ w["query"]) / width**0.5 + w["lag"][[p - q for q in seen]]
            a = np.exp(a - a.max())
            logits = (a / a.sum()) @ (x @ w["value"]) @ w["out"] + m.bigram[inputs[p]]
            logits = logits - logits.max() - np.log(np.exp(logits - logits.max()).sum())
            logp.append(logits[m.classes[target]] + m.within[target])
            begins.append(np.log(np.exp(logits[m.starts]).sum()))
        score = mixed = at = 0
        for word, name in zip(words, [*lower(t), b"\0"]):
            spelt = sum(logp[at : at + len(word)]) - begins[at]
            at += len(word)
            spelt += begins[at] if at < len(stream) else 0
            base = (counts[name] + 0.5) / (n + 0.5 * (v + 1))
            score += spelt / math.log(10)
            mixed += math.log10(max(0.6 * base * (1 if counts[name] else math.exp(spelt)) + 0.4 * math.exp(spelt), 1e-300))
        assert math.isclose(got[i].score, score, rel_tol=2e-3, abs_tol=2e-3), i
        assert math.isclose(got[i].mixed_score, mixed, rel_tol=2e-3, abs_tol=2e-3), i


def test_lm_very_long_word(spark):
    d = docs(spark, (0, "z" * 120_000), (1, "short " * 10), (2, "ab" * 90_000 + " end"), (None, "no id"))
    got = {r.doc_id: r for r in lm_scoring.score_documents(d, queries.piece_model()).collect()}
    assert [got[i].n_tokens for i in (0, 1, 2, None)] == [2, 11, 3, 3] and all(math.isfinite(r.score) for r in got.values())


def test_numbered_words():
    import pyarrow as pa

    texts = ["A b  a", "", " \t\n", "x", "\x0bÉ a\r"]
    words, found, counts = lm_scoring.numbered(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    assert [[words[k].encode() for k in found[at[i] : at[i + 1]]] for i in range(len(texts))] == [lower(t) for t in texts]


def small_model(classes=6, ids=40, seed=0):
    rng = np.random.default_rng(seed)
    of = rng.integers(0, classes, ids)
    of[:classes] = np.arange(classes)
    w = attention.Attention.initial(of, classes)
    w["out"] = rng.normal(0, 0.3, w["out"].shape).astype(np.float32)
    size = np.bincount(of, minlength=classes)
    return attention.Attention(of, np.arange(classes) < 2, np.log(1 / size[of]).astype(np.float32), rng.normal(0, 1, (ids, classes)).astype(np.float32), w)


def test_attention_is_a_distribution_and_causal():
    m = small_model()
    rng = np.random.default_rng(1)
    stream, sizes = rng.integers(0, 40, 70), np.array([1, 40, 29])
    inputs, targets, first, place = lm_scoring.laid_out(stream, sizes, 1)
    assert (targets.ravel()[place] == stream).all() and inputs[0, 0] == inputs[1, 0] == 1 and first.sum() == 3
    score, start = m.score(inputs, targets, first)
    total, begins = np.zeros(score.shape), np.zeros(score.shape)
    for k in range(40):
        p = np.exp(m.score(inputs, np.full_like(targets, k), first)[0].astype(float))
        total += p
        begins += p * m.starts[m.classes[k]]
    assert np.allclose(total, 1, atol=1e-4) and np.allclose(np.log(begins), start, atol=1e-4)
    alone = lm_scoring.laid_out(stream[1:41], np.array([40]), 1)
    same = m.score(*alone[:3])[0].ravel()[alone[3]]
    assert np.allclose(same, score.ravel()[place[1:41]], atol=1e-4)  # other texts and later ids change nothing
    later = inputs.copy()
    later[2, 9:] = 5
    assert np.allclose(m.score(later, targets, first)[0][2, :9], score[2, :9], atol=1e-5)


def test_attention_gradients():
    m = small_model()
    rng = np.random.default_rng(2)
    ids, targets = rng.integers(0, 40, (3, 32)), rng.integers(0, 40, (3, 16))
    first, valid = np.array([True, False, False]), rng.random((3, 16)) < 0.8
    w = {k: v.astype(np.float64) for k, v in m.weights.items()}
    loss, g = attention.gradients(w, m.bigram, m.classes, ids, targets, first, valid)
    at, rows = g["embed"]
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][at] = rows
    for name in attention.TRAINED:
        flat = w[name].ravel()
        for k in rng.integers(0, flat.size, 4):
            keep, e = flat[k], 1e-4
            flat[k] = keep + e
            up = attention.gradients(w, m.bigram, m.classes, ids, targets, first, valid)[0]
            flat[k] = keep - e
            down = attention.gradients(w, m.bigram, m.classes, ids, targets, first, valid)[0]
            flat[k] = keep
            assert abs((up - down) / (2 * e) - g[name].ravel()[k]) < 1e-3


def test_every_training_window_is_trained(spark, monkeypatch):
    """Every id after every context of every training text, short texts too, is trained once; none of the held-out texts."""
    d = docs(spark, *((k, " ".join(f"w{k} x{j}" for j in range(k))) for k in range(60)))
    pieces = lm_scoring.tokenizer(open(queries.piece_model(), "rb").read())
    want = Counter()
    for k in range(60):
        if not lm_scoring.held_out(k):
            ids = [i for w in " ".join(f"w{k} x{j}" for j in range(k)).split() for i in pieces.encode(w)] + [pieces.eos_id()]
            seq = [pieces.bos_id(), *ids]
            for at in range(0, len(ids), attention.BLOCK):
                targets = tuple(ids[at : at + attention.BLOCK])
                want[tuple(seq[max(0, at - attention.BLOCK) : at + len(targets)]), targets] += 1
    blobs, trained = [], lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", lambda m, batches, rounds, begin: blobs.append(([r.blob for r in batches.collect()], rounds, begin)) or trained(m, batches, rounds, begin))
    assert lm_scoring.score_documents(d, queries.piece_model()).count() == 60
    got, (found, rounds, begin) = Counter(), blobs[0]
    for blob in found:
        windows = lm_scoring.training_windows(bytes(blob), begin)
        for turn in range(rounds):
            for ids, targets, first, valid in zip(*(x[turn::rounds] for x in windows)):
                n = int(valid.sum())
                seen = ids[attention.BLOCK if first else 0 :]
                got[tuple(seen[: len(seen) - attention.BLOCK + n].tolist()), tuple(targets[:n].tolist())] += 1
    assert got == want


def test_attention_shifts_only_far_sums(monkeypatch):
    """Exponentials are summed without a shift where that is safe: the same losses, gradients and scores as with one; and
    where it is not safe they are shifted and stay finite."""
    rng = np.random.default_rng(5)
    m = small_model()
    inputs, targets, first, _ = lm_scoring.laid_out(rng.integers(0, 40, 1500), np.array([1, 300, 16, 33, 1150]), 1)
    windows = np.concatenate((np.concatenate((inputs[:1], inputs[:-1])), inputs), axis=1), targets, first, rng.random(targets.shape) < 0.9
    for stretch in (1, 2000):
        w = {k: v * np.float32(stretch if k in ("query", "out") else 1) for k, v in m.weights.items()}
        found = []
        for plain in (60.0, 0.0):  # 0: always shifted
            monkeypatch.setattr(attention, "PLAIN", plain)
            loss, g = attention.gradients(w, m.bigram, m.classes, *windows)
            score, start = attention.Attention(m.classes, m.starts, m.within, m.bigram, w).score(inputs, targets, first)
            found.append((np.float32(loss), *g.pop("embed"), *g.values(), score, start))
        for x, y in zip(*found):
            assert np.isfinite(x).all() and np.allclose(x, y, rtol=1e-3, atol=1e-4 * max(1, np.abs(y).max())), stretch


def test_attention_training_lowers_loss():
    m = small_model()
    rng = np.random.default_rng(3)
    seq = np.tile([3, 9, 27, 14], 200)
    ids = np.stack([seq[k : k + 32] for k in rng.integers(0, 700, 300)])
    targets = np.stack([seq[(np.flatnonzero(seq == i[16])[0]) + 1 : (np.flatnonzero(seq == i[16])[0]) + 17] for i in ids])
    data = (ids, targets, np.zeros(300, bool), np.ones((300, 16), bool))
    before = attention.gradients(m.weights, m.bigram, m.classes, *data)[0]
    w = m.weights
    for seed in range(5):
        w = attention.fit(w, m.bigram, m.classes, data, batch=32, seed=seed)
    assert attention.gradients(w, m.bigram, m.classes, *data)[0] < 0.5 * before


# SimHash


def plain_fingerprint(text, width=4):
    import xxhash

    w = lower(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), seed=42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(table):
    for r in table.limit(60).collect():
        assert simhash.fingerprint(r.text) == plain_fingerprint(r.text)
    for t in ("", " \n", "one", "one two three", "A b C d", "x " * 300):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def near(a, b):
    return int(a ^ b).bit_count() <= simhash.LIMIT


@pytest.mark.parametrize("hot", [5, 10_000])
def test_links_connect_like_brute_force(spark, monkeypatch, hot):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for f in fps[:60]:  # chains and clouds of near fingerprints
        for _ in range(rng.integers(1, 6)):
            x = f
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.append(x)
    fps += [0, 1, 3]
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()}
    def groups(pairs):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    want = groups((a, b) for i, a in enumerate(signed) for b in signed[:i] if near(a & (1 << 64) - 1, b & (1 << 64) - 1))
    assert groups(got) == want
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(found.get(x, x) == want[x] for x in signed)


def test_forest_of_a_large_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) for b in base]))[:, None]
    table = np.array([[int(x[0] ^ np.uint64(w)).bit_count() for w in simhash.WHOLE] for x in fps], np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    a, b = simhash.forest(fps)
    assert len(a) == len(fps) - 3 and simhash.survivors(fps[a], fps[b]).all()
    assert all(np.array_equal(x, y) for x, y in zip(simhash.forest(fps, simhash.LIMIT, table), (a, b)))  # the table discards no link
    x, y = simhash._run_links(fps, simhash.LIMIT, table)
    assert simhash.survivors(fps[x], fps[y]).all() and len(x) >= len(fps) - 3


def test_local_components():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    node, root = simhash.local_components(np.concatenate((a, np.arange(600, 700))), np.concatenate((b, np.arange(601, 701))))
    label = dict(zip(node.tolist(), root.tolist()))
    group = {x: x for x in range(701)}
    for _ in range(701):
        for x, y in [*zip(a.tolist(), b.tolist()), *((k, k + 1) for k in range(600, 700))]:
            group[x] = group[y] = min(group[x], group[y])
    assert all(label.get(x, x) == group[x] for x in range(701))


def test_simhash_documents(spark, table):
    d = table.select("doc_id", "text").unionByName(docs(spark, (10**6, None), (10**6 + 2, ""), (10**6 + 1, " "))).withColumn("component_id", F.lit(1))
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    assert {got[10**6 + k].component_id for k in range(3)} == {10**6} and got[10**6].fp == 0
    by = defaultdict(list)
    for r in got.values():
        by[r.component_id].append(r.doc_id)
    assert all(min(v) == k and all(got[i].component_size == len(v) for i in v) for k, v in by.items())
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_similar_groups_find_edited_copies(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for g in range(40):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        rows.append((k, " ".join(w), g))
        k += 1
        for _ in range(3):
            x = list(w)
            for at in rng.integers(0, 300, 2):  # ten of some 300 shingles change: a similarity over 0.9
                x[at] = "edited"
            rows.append((k, " ".join(x), g))
            k += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, g int")
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(d).collect()}
    first = {g: min(i for i, _, x in rows if x == g) for _, _, g in rows}
    wrong = sum(got[i] != first[g] for i, _, g in rows)
    assert wrong <= 2 and all(got[i] // 4 == i // 4 for i in got)


# SentencePiece


def test_similar_groups_like_brute_force(spark):
    """Pairs around the threshold: groups are the components of an exact similarity of 0.8 or more; nothing below is linked."""
    rng = np.random.default_rng(11)
    texts = []
    for edits in (0, 2, 3, 4, 4, 4, 5, 5, 6, 7, 9, 12) * 12:
        w = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        texts.append(" ".join(w))
        for at in rng.permutation(39)[:edits]:
            w[5 * at + 2] = "edited"
        texts.append(" ".join(w))
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(d).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    missed = above = 0
    for k in range(0, len(texts), 2):
        x, y = shingles(texts[k]), shingles(texts[k + 1])
        linked, similar = got[k] == got[k + 1], 5 * len(x & y) >= 4 * len(x | y)
        assert similar or not linked
        above, missed = above + similar, missed + (similar and not linked)
    assert above == 72 and missed <= 2
    assert all(g // 2 == i // 2 for i, g in got.items())


def test_similar_groups_merge_what_the_first_pass_leaves_apart(spark, monkeypatch):
    """Eight near copies that the first pass links in four pairs only are one group after the second."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:100] + [f"edit{k}"] + words[100:]) for k in range(8)]

    def in_pairs(nodes):
        ids = sorted(r.id for r in nodes.collect())
        return spark.createDataFrame([*zip(ids[::2], ids[1::2])], "a long, b long")

    monkeypatch.setattr(simhash, "candidates", in_pairs)
    got = simhash.similar_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert len(got) == 8 and {r.group_id for r in got} == {0}


def test_workers_return_arrow_memory(monkeypatch):
    import pyarrow

    from tidemark.llm import common

    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(len(calls))})
    monkeypatch.setattr(pyarrow, "default_memory_pool", pool)
    assert list(common.tidy(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert calls == [0]


def test_small_work_tables_are_few_files(spark, monkeypatch):
    """However many shuffle partitions: a table of few rows is not dealt out over a file for each."""
    from tidemark.llm import common

    base = [" ".join(f"w{g}x{i}" for i in range(40)) for g in range(12)]
    table = docs(spark, *((20 * g + k, " ".join([base[g], f"end{k}"])) for g in range(12) for k in range(20)))
    made = []
    monkeypatch.setattr(common, "_MADE", made)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = {r.doc_id: r.group_id for r in simhash.similar_groups(table).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert out == {20 * g + k: 20 * g for g in range(12) for k in range(20)}
    steps = {path.rsplit("/", 1)[1].rsplit("-", 1)[0]: path for path in made}
    files = {name: spark.read.parquet(path).inputFiles() for name, path in steps.items() if name in ("wide-different", "wide-pairs", "wide-near", "wide-labels", "wide-more", "wide-joined")}
    assert len(files) == 6 and all(len(f) == 1 for f in files.values()), {k: len(f) for k, f in files.items()}


def test_near_pairs_name_every_row():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (6, 4)).astype(np.uint64)
    fps = np.concatenate([base ^ np.uint64(k) for k in range(12)])
    d = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(p, q)) for q in fps] for p in fps])
    near = {(i, j) for i in range(72) for j in range(i + 1, 72) if d[i, j] <= 8}
    some = {*zip(*(x.tolist() for x in simhash._first_near(fps, 8)))}
    assert some <= near and {i for p in some for i in p} == {i for p in near for i in p} and len(some) < 2 * 72
    out = [b for b in simhash.key_pairs(4, 8)(iter([pa_batch(np.zeros(72, np.int64), np.arange(72), fps)]))]
    assert {(a, b) for o in out for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist())} <= near


def test_prefix_pairs_miss_nothing_and_stay_few(spark):
    rng = np.random.default_rng(5)
    sets = []
    for size, own, n in ((200, 18, 40), (200, 26, 40), (200, 50, 60), (37, 4, 20), (6, 1, 6)):  # around a template each
        template = rng.integers(0, 2**63, size).astype("<u8")
        for _ in range(n):
            x = template.copy()
            x[rng.choice(size, int(rng.integers(0, own + 1)) if own < 40 else own, replace=False)] = rng.integers(0, 2**63)
            x[: own // 2] = rng.integers(0, 2**63, own // 2)
            sets.append(np.unique(x))
    sets.append(np.empty(0, "<u8"))
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, shingles binary").repartition(3)
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "of_node long, label long")
    got = {(r.a, r.b) for r in simhash.prefix_pairs(frame, labels).collect()}
    python = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if python[i] and 5 * len(python[i] & python[j]) >= 4 * len(python[i] | python[j])}
    want -= {(0, 1), (0, 2), (1, 2)}
    assert want and want <= got and len(got) < len(sets) ** 2 // 8
    assert not any(80 <= i < 140 for p in got for i in p)  # similarity far too small: no pairs at all
    assert simhash.prefix_pairs(frame.limit(0), labels).count() == 0


def pa_batch(keys, ids, fps):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, ids, *(np.ascontiguousarray(fps[:, i]).view(np.int64) for i in range(fps.shape[1])))], ["key", "id", *"wxyz"])



def test_codec_equals_library(table):
    import random

    import sentencepiece

    path = queries.piece_model()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.Codec(piece_codec.load_vocabulary(path))
    rng = random.Random(3)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    parts = list("aabcdeerthing  ▁\n\té中日漢字\U0001f600\x00") + ["the", "ation", "   ", "<s>", "<0x41>"]
    texts = ["", " ", "  a  ", "\n a", "▁", "a▁b", "x" * 3000, " " * 40] + [r.text for r in table.limit(80).collect()]
    texts += ["".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for t in texts:
        ids = codec.encode(t)
        want = model.encode(t, add_bos=True, add_eos=True)
        assert ids.tolist() == want, repr(t)
        assert codec.decode(ids) == model.decode(want), repr(t)
    for _ in range(1500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(6)]
        assert codec.decode(np.array(ids)) == model.decode(ids), ids


def test_codec_fills_its_table_with_few_calls(monkeypatch):
    """A stretch whose pairs of pieces are known costs less than two calls a character; forgetting pairs changes no ids."""
    import random
    import sys

    codec = piece_codec.Codec(piece_codec.load_vocabulary(queries.piece_model()))
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choice(["th", "ing", "er", "an", "ation", "é", "q", "7"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    want, calls = [codec._encode_stretch(w) for w in words], Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        again = [codec._encode_stretch(w) for w in words]
    finally:
        sys.setprofile(None)
    assert again == want and calls["call"] + calls["c_call"] < 2 * sum(map(len, words))
    monkeypatch.setattr(piece_codec, "PAIRS", 20)
    codec.forget_pairs()
    assert [codec._encode_stretch(w) for w in words] == want and codec.tested <= 20


def test_split_table_merges_like_the_procedure():
    rank = {p: i for i, p in enumerate(["ab", "bc", "abc", "cd", "abcd"])}
    assert piece_codec.merged(list("abcd"), rank) == ["abcd"] and piece_codec.split_of("abc", rank) == ("ab", "c")


def test_encoded_documents(spark):
    d = docs(spark, (1, "Hello world"), (2, None), (3, ""), (4, "a " * 20000)).withColumn("ids", F.lit(0))
    enc = piece_codec.encoded(d, queries.piece_model())
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got[2] == got[3] == [1, 2] and got[1][0] == 1 and got[1][-1] == 2
    back = {r.doc_id: r.text for r in piece_codec.decoded(enc, queries.piece_model()).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "a " * 20000}
    digests = {r.doc_id: r for r in piece_codec.round_trip(d, queries.piece_model()).collect()}
    assert digests[1].ids_sha256 == hashlib.sha256(np.array(got[1], "<u4").tobytes()).hexdigest() and digests[4].n_tokens == len(got[4])
    assert piece_codec.encoded(d.limit(0), queries.piece_model()).count() == 0


# suffix-array dedup


def plain_cut(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        gone, end = bytearray(len(t)), 0
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            if w in seen:
                a = max(k, end)
                gone[a : k + 100] = b"\1" * (k + 100 - a)
                end = k + 100
            else:
                seen.add(w)
        out[i] = bytes(c for c, g in zip(t, gone) if not g), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
    return out


@pytest.mark.parametrize("common,buffer", [(1000, 900_000), (2, 2_000)])
def test_suffix_dedup(spark, monkeypatch, common, buffer):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(chr(97 + int(c)) + (" " if c % 5 == 0 else "") for c in rng.integers(0, 20, n))
    shared = [word(n) for n in (99, 100, 101, 160, 400, 3000)]
    rows = [(1, "a" * 450), (2, "ab" * 300), (3, "é" * 120), (4, None), (5, ""), (6, word(99)), (7, "a" * 99), (8, "b" + "a" * 100 + "c")]
    for i in range(10, 60):
        rows.append((i, word(int(rng.integers(0, 300))) + shared[int(rng.integers(0, 6))] + word(int(rng.integers(0, 80))) + shared[int(rng.integers(0, 6))]))
    d = docs(spark, *rows).withColumn("n_spans", F.lit("x"))
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(d).collect()}
    want = plain_cut({i: (t or "").encode() for i, t in rows})
    for i, (kept, n) in want.items():
        assert (bytes(got[i].kept), got[i].n_spans, got[i].kept_sha256) == (kept, n, hashlib.sha256(kept).hexdigest()), i
        assert got[i].n_removed == got[i].n_bytes - len(kept)


def test_suffix_dedup_edges(spark):
    text = " ".join(f"w{k}" for k in range(80))
    got = suffix_dedup.without_repeats(docs(spark, (1, text), (1, text), (None, text)), contents=False).collect()
    assert sorted((r.doc_id or 9, r.n_removed) for r in got) == [(1, 0), (1, 0), (9, len(text))]
    assert suffix_dedup.without_repeats(docs(spark, (1, "x")).limit(0)).count() == 0


def test_suffix_ranks_are_in_byte_order():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    places = np.arange(0, 2900, 7)
    rank = suffix_dedup.suffix_ranks(data, places)
    strings = [data[p : p + 100].tobytes() for p in places]
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert [order[s] for s in strings] == rank.tolist()
