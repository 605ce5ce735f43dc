"""LM scoring of whole texts: a causal self-attention model on subword ids, and corpus word counts.

Words are spelled in subword ids. The attention model (attention.py) gives P(word | context) as the
product over its ids, closed by the chance that the next id begins a word; the sum of its logarithms over
a text is ``score``. The base is the smoothed unigram of the training texts, in which all words they lack
share one slot. ``mixed_score`` mixes both, word by word,
  (1 - SHARE) * base probability  +  SHARE * P(word | context),
where words that training lacks get the slot's probability times P(word | context): the attention model
tells them apart, and the probabilities of all words add up to one at most.

What is learned covers every training text: word counts, pair counts of ids (class of the next id
after each id, probabilities within classes) and, for the attention weights, every window of every
training text. Weights are trained in a single pass on the executors: each window is used once, in one
of the rounds, between which weights are averaged. Trainers read the stored batches where they lie;
only tables bounded by the tokenizer's vocabulary reach the driver.

Flow: texts are read once and become batches of word numbers with a small dictionary each. A batch
asks the owners of its words for counts; each different word of a batch travels once, whatever its
frequency. The answers meet the stored batch again, which is then scored. A batch is bounded in bytes.

Defined cases: null text is empty and has the end token only; a null id counts as the empty text in the
choice of training texts; without training texts the scores rest on the untrained model; repeated
rows are texts of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import attention
from .attention import BLOCK, Attention
from .common import staged, text_or_empty, tidy, worker_cache
from .piece_codec import SPACE, load_vocabulary

SHARE = 0.4
CLASSES, KINDS = 128, 256
BATCH_BYTES, WORDS_PER_TASK = 5_000_000, 2_000_000
#: Kinds of work rows; a batch sorts after the answers to its questions.
ASKED, PAIRS, WEIGHTS, BATCH, STATS = "asked", "pairs", "weights", "batch", "stats"
#: What a stats row counts: different training words, training tokens.
WORDS, TOKENS = -1, -2
ROW = "kind string, part int, batch long, n long, blob binary"
WEIGHT_PARTS = 16
#: Bytes of text for each part of the pair counts, of which there are MOST_PARTS at most.
PAIR_BYTES, MOST_PARTS = 100_000_000, 4096
#: Pairs held before they are added up.
PAIRS_HELD = 4_000_000


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpacked(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(dtypes), 8).tolist()
    at, out = 8 * (1 + len(dtypes)), []
    for dtype, size in zip(dtypes, sizes):
        out.append(np.frombuffer(blob, dtype, size // np.dtype(dtype).itemsize, at))
        at += size
    return out


def record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "part", "batch", "n", "blob"])


BATCH_TYPES = ("i8", "u1", "i4", "u4", "u4", "u2", "i4")  # ids, held out, words a text, word numbers, ids a word, their ids, words a part


def spelled(numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id stream of word numbers, and how many ids each word has."""
    begin = np.cumsum(lengths, dtype=np.int64) - lengths
    each = lengths[numbers].astype(np.int64)
    inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return ids[np.repeat(begin[numbers], each) + inside], each


def laid_out(stream: np.ndarray, sizes: np.ndarray, begin_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of inputs and next ids, which blocks begin a text, and the place of every id in them."""
    blocks = -(-sizes // BLOCK)
    start = (np.cumsum(blocks) - blocks) * BLOCK
    place = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(stream))
    total = int(blocks.sum())
    targets = np.zeros(total * BLOCK, np.int32)
    targets[place] = stream
    inputs = np.zeros(total * BLOCK, np.int32)
    inputs[1:] = targets[:-1]
    inputs[start] = begin_id
    first = np.zeros(total, bool)
    first[start // BLOCK] = True
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), first, place


def tokenizer(model: bytes):
    """One SentencePiece processor for each Python worker."""
    import sentencepiece

    cache = worker_cache()
    if cache.get("sentencepiece", (None,))[0] != model:
        cache["sentencepiece"] = (model, sentencepiece.SentencePieceProcessor(model_proto=model))
    return cache["sentencepiece"][1]


def numbered(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, lower-cased in A-Z, the word numbers of all texts, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(full)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    found = (words if full.all() else words.filter(pa.array(full))).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False), np.diff(ends)


def encode_batches(shared, parts: int, pair_parts: int):
    """Texts to batches: word numbers and dictionary, questions for counts, pair counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokenizer(shared.value)
        number, base = 0, TaskContext.get().partitionId() << 24
        held, rows = 0, []
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:  # whole texts, until the batch is full
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + BATCH_BYTES - held, "right")))
                rows.append(batch.slice(start, stop - start))
                held += int(sizes[min(stop, len(sizes)) - 1] - before)
                start = stop
                if held >= BATCH_BYTES or start < batch.num_rows:
                    yield record(encode(pieces, pa.Table.from_batches(rows).combine_chunks(), base + number))
                    number, held, rows = number + 1, 0, []
        if rows:
            yield record(encode(pieces, pa.Table.from_batches(rows).combine_chunks(), base + number))

    def encode(pieces, texts: pa.Table, batch: int) -> list[tuple]:
        import xxhash

        ids = texts.column(0).to_pylist()
        bos, eos, size = pieces.bos_id(), pieces.eos_id(), pieces.get_piece_size()
        words, found, counts = numbered(pa.concat_arrays(texts.column(1).chunks) if texts.num_rows else pa.array([], pa.string()))
        counts = (counts + 1).astype(np.int32)  # with the end, which is the last number
        stream = np.full(int(counts.sum()), len(words), np.uint32)
        inside = np.ones(len(stream), bool)
        inside[np.cumsum(counts) - 1] = False
        stream[inside] = found
        hash64 = xxhash.xxh3_64_intdigest
        hashes = np.array([*map(hash64, words), hash64(b"\0")], np.uint64)
        spell = pieces.encode(words, num_threads=1) + [[eos]]
        part = (hashes >> np.uint64(16)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        again = np.empty(len(order), np.uint32)
        again[order] = np.arange(len(order), dtype=np.uint32)
        stream, hashes, part = again[stream], hashes[order], part[order]
        spell = [spell[i] for i in order.tolist()]
        lengths = np.fromiter(map(len, spell), np.uint32, len(spell))
        spelling = np.fromiter(chain.from_iterable(spell), np.uint16, int(lengths.sum(dtype=np.int64)))
        out = np.array([held_out(i) for i in ids], np.uint8)
        trained = np.repeat(out == 0, counts)
        seen = np.bincount(stream[trained], minlength=len(hashes)).astype(np.uint64)
        per_part = np.bincount(part, minlength=parts).astype(np.int32)
        ends = np.cumsum(per_part)
        rows = [(ASKED, int(p), batch, int(per_part[p]), packed(hashes[ends[p] - per_part[p] : ends[p]], seen[ends[p] - per_part[p] : ends[p]])) for p in np.flatnonzero(per_part)]
        known = np.array([i is not None for i in ids], np.uint8)
        doc_ids = np.array([0 if i is None else i for i in ids], np.int64)
        rows.append((BATCH, 0, batch, len(ids), packed(doc_ids, out | (1 - known) << 1, counts, stream, lengths, spelling, per_part)))
        if trained.any():
            rows += pair_rows(stream[trained], counts[out == 0], lengths, spelling, seen, bos, size, batch)
        return rows

    def pair_rows(stream, counts, lengths, spelling, seen, bos: int, size: int, batch: int) -> list[tuple]:
        """Counts of (id, next id): inside words by the words' counts, and between neighbouring words."""
        begin = np.cumsum(lengths, dtype=np.int64) - lengths
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.ones(len(spelling), bool)
        inside[begin] = False
        at = np.flatnonzero(inside)
        ids = spelling.astype(np.int64)
        before = np.empty(len(stream), np.int64)
        before[1:] = ids[begin[stream[:-1]] + lengths[stream[:-1]] - 1]
        before[np.cumsum(counts) - counts] = bos
        across = np.sort((before * size + ids[begin[stream]]).astype(np.uint32))
        first = np.flatnonzero(np.diff(across, prepend=~across[:1]) != 0)
        keys = np.concatenate((ids[at - 1] * size + ids[at], across[first].astype(np.int64)))
        weight = np.concatenate((seen[owner[at]].astype(np.float64), np.diff(np.append(first, len(across)))))
        pairs, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weight).astype(np.int64)
        pairs, total = pairs[total > 0], total[total > 0]
        of = pairs // size % pair_parts
        return [(PAIRS, p, batch, 0, packed(pairs[mine], total[mine])) for p in range(pair_parts) if (mine := of == p).any()]

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (kind, part, batch, n, blob), sorted by part: part by part."""
    part, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            if row[1] != part and rows:
                yield rows
                rows = []
            part = row[1]
            rows.append(row)
    if rows:
        yield rows


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to the batches' questions, in their order; and the numbers of training tokens and words."""
    for rows in _parts(batches):
        cells = [unpacked(r[4], "u8", "u8") for r in rows]
        words, which = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
        total = np.zeros(len(words), np.uint64)
        np.add.at(total, which, np.concatenate([c[1] for c in cells]))
        answers, at, out = total[which], 0, []
        for (_, part, batch, n, _), (hashes, _) in zip(rows, cells):
            out.append((ASKED, part, batch, n, packed(answers[at : at + len(hashes)])))
            at += len(hashes)
        out += [(STATS, rows[0][1], WORDS, int(np.count_nonzero(total)), b""), (STATS, rows[0][1], TOKENS, int(total.sum()), b"")]
        yield record(out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (part, n, blob) one by one."""
    for b in batches:
        for part, n, blob in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4)):
            yield part, n, blob.as_py()


def sum_pairs(size: int):
    """Pairs of each task added up; what is held stays bounded by the different pairs of its parts."""

    def added(cells: list) -> list:
        pairs, which = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
        return [(pairs, np.bincount(which, np.concatenate([c[1] for c in cells])).astype(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = [], 0
        for _, _, blob in _rows(batches):
            cells.append(unpacked(blob, "i8", "i8"))
            held += len(cells[-1][0])
            if held > PAIRS_HELD + 2 * len(cells[0][0]):
                cells, held = added(cells), 0
        if cells:
            [(pairs, total)] = added(cells)
            yield pa.RecordBatch.from_arrays([pa.array((pairs // size).astype(np.int32)), pa.array((pairs % size).astype(np.int32)), pa.array(total)], ["before", "next", "n"])

    return run


def kind_of(ids: np.ndarray) -> np.ndarray:
    """Kinds of ids by which contexts are told apart: half are the first ids of the merge order, half are hashed."""
    half, base = KINDS // 2, 259
    return np.where((ids >= base) & (ids < base + half), ids - base, half + (ids.astype(np.int64) * 40503 >> 4) % half)


def table(pairs: DataFrame, row: str, column: str, of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Counts of (row id, of[column id]) over all pairs; at most ``shape`` cells are collected."""
    shared = pairs.sparkSession.sparkContext.broadcast(of.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value[b.column(1).to_numpy()]), b.column(2)], ["a", "b", "n"])

    cells = pairs.select(row, column, "n").mapInArrow(tidy(run, ("sentencepiece",)), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape, np.float32)
    out[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["n"].to_numpy()
    return out


def initial_model(pairs: DataFrame, vocabulary: dict) -> Attention:
    size = len(vocabulary["pieces"])
    starts = np.array([p.startswith(SPACE) for p in vocabulary["pieces"]])
    starts[vocabulary["eos"]] = True
    everything = np.arange(size)
    classes = attention.cluster(table(pairs, "next", "before", kind_of(everything), (size, KINDS)), np.where(starts, 0, 1), CLASSES // 2)
    after = table(pairs, "before", "next", classes, (size, CLASSES))
    ids = table(pairs, "next", "before", np.zeros(size), (size, 1))[:, 0].astype(np.float64) + 0.5
    total = np.bincount(classes, ids, CLASSES)
    prior = (after.sum(axis=0) + 0.5) / (after.sum() + 0.5 * CLASSES)
    logits = np.log((after + 20 * prior) / (after.sum(axis=1, keepdims=True) + 20)).astype(np.float32)
    return Attention(classes, np.arange(CLASSES) < CLASSES // 2, np.log(ids / total[classes]).astype(np.float32), logits, Attention.initial(classes, CLASSES))


def training_windows(blob: bytes, begin_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a stored batch's training texts: ids of a block and the block before it, next ids, which begin a text, which ids count."""
    _, flags, counts, numbers, lengths, spelling, _ = unpacked(blob, *BATCH_TYPES)
    mine = (flags & 1) == 0
    numbers, counts = numbers[np.repeat(mine, counts)], counts[mine]
    if not len(counts):
        none = np.empty((0, BLOCK), np.int32)
        return np.empty((0, 2 * BLOCK), np.int32), none, np.empty(0, bool), none.astype(bool)
    stream, each = spelled(numbers, lengths, spelling)
    inputs, targets, first, place = laid_out(stream, np.add.reduceat(each, np.cumsum(counts, dtype=np.int64) - counts), begin_id)
    valid = np.zeros(targets.size, bool)
    valid[place] = True
    before = np.concatenate((inputs[:1], inputs[:-1]))
    before[first] = begin_id  # of another text; not seen
    return np.concatenate((before, inputs), axis=1), targets, first, valid.reshape(-1, BLOCK)


def trained(model: Attention, batches: DataFrame, rounds: int, begin_id: int) -> Attention:
    """One pass over all windows in rounds on the executors: each trainer on its own batches, averaged by number of windows."""
    spark = batches.sparkSession
    shapes = {name: model.weights[name].shape for name in attention.TRAINED}

    def train_with(shared, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, n = shared.value, 0
            w = m.weights
            for b in batches:
                for blob in b.column(0):
                    windows = [x[turn::rounds] for x in training_windows(blob.as_py(), begin_id)]
                    if len(windows[0]):
                        w = attention.fit(w, m.bigram, m.classes, windows, seed=turn)
                        n += len(windows[0])
            if not n:
                return
            flat = np.concatenate([w[name].ravel() for name in attention.TRAINED]) * np.float32(n)
            pieces = np.array_split(flat, WEIGHT_PARTS)
            yield record([(WEIGHTS, i, 0, n, packed(p)) for i, p in enumerate(pieces)])

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_rows(batches), key=lambda r: r[0]):  # one after the other, not all at once
            total, windows = 0, 0
            for _, n, blob in rows:
                total, windows = total + np.frombuffer(blob, np.float32, offset=16).astype(np.float64), windows + n
            yield record([(WEIGHTS, part, 0, 0, packed((total / windows).astype(np.float32)))])

    blobs = batches.select("blob")  # as the files lie: no shuffle
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        found = blobs.mapInArrow(tidy(train_with(shared, turn), ("sentencepiece",)), ROW).repartitionById(WEIGHT_PARTS, "part").sortWithinPartitions("part", "n").mapInArrow(tidy(average, ("sentencepiece",)), ROW).collect()
        if not found:
            continue
        flat = np.concatenate([np.frombuffer(r.blob, np.float32, offset=16) for r in sorted(found, key=lambda r: r.part)])
        weights, at = {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            weights[name] = flat[at : at + n].reshape(shape)
            at += n
        model = Attention(model.classes, model.starts, model.within, model.bigram, weights)
    return model


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double"


def score_batches(shared, tokens: int, words: int, begin_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, answers = shared.value, []
        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(4)):
                if kind == ASKED:  # sorted before its batch, by part
                    answers.append(unpacked(blob.as_py(), "u8")[0])
                else:
                    yield scored(model, np.concatenate(answers).astype(np.float64), *unpacked(blob.as_py(), *BATCH_TYPES))
                    answers = []

    def scored(model: Attention, count, doc_ids, flags, counts, numbers, lengths, spelling, _) -> pa.RecordBatch:
        c = count[numbers]
        at = np.cumsum(counts, dtype=np.int64) - counts
        base = np.log10((count + 0.5) / (tokens + 0.5 * (words + 1)))[numbers]
        stream, each = spelled(numbers, lengths, spelling)
        sizes = np.add.reduceat(each, at)
        inputs, targets, first, place = laid_out(stream, sizes, begin_id)
        score, start = (x.ravel() for x in model.score(inputs, targets, first))
        score, start = score[place].astype(np.float64), start[place].astype(np.float64)
        ends = np.cumsum(each)
        begins = ends - each
        spell = np.add.reduceat(score, begins) - start[begins]
        close = start[np.minimum(ends, len(start) - 1)]
        last = np.zeros(len(numbers), bool)
        last[at + counts - 1] = True
        spell += np.where(last, 0.0, close)  # the text's end closes its last word
        spelt = np.exp(spell)
        mixed = np.log10(np.maximum((1 - SHARE) * 10**base * np.where(c > 0, 1.0, spelt) + SHARE * spelt, 1e-300))
        total = lambda x: pa.array(np.add.reduceat(x, at))
        null = (flags & 2) > 0
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, mask=null), pa.array((flags & 1) > 0), pa.array(counts.astype(np.int64)), total((c > 0).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)), total(base), total(spell / np.log(10)), total(mixed)],
            [f.split()[0] for f in SCORED.split(", ")],
        )

    return run


def score_documents(docs: DataFrame, model_path: str, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (of the attention model), mixed_score."""
    spark = docs.sparkSession
    vocabulary = load_vocabulary(model_path)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-size // (6 * WORDS_PER_TASK)))
    pair_parts = min(max(16, -(-size // PAIR_BYTES)), MOST_PARTS)

    work = staged(texts.mapInArrow(tidy(encode_batches(shared, parts, pair_parts), ("sentencepiece",)), ROW), "lm-batches", by="kind")
    of = lambda kind: work.where(F.col("kind") == kind).select("kind", "part", "batch", "n", "blob")
    answers = staged(of(ASKED).repartitionById(parts, "part").sortWithinPartitions("part", "batch").mapInArrow(tidy(count_words, ("sentencepiece",)), ROW), "lm-counts", by="kind")
    totals = {r.batch: r.n for r in answers.where(F.col("kind") == STATS).groupBy("batch").agg(F.sum("n").alias("n")).collect()}
    words, tokens = totals.get(WORDS, 0), totals.get(TOKENS, 0)

    pairs = of(PAIRS).repartitionById(pair_parts, "part").sortWithinPartitions("part", "batch").mapInArrow(tidy(sum_pairs(len(vocabulary["pieces"])), ("sentencepiece",)), "before int, next int, n long")
    pairs = staged(pairs, "lm-pairs")
    model = trained(initial_model(pairs, vocabulary), of(BATCH), rounds, vocabulary["bos"])

    both = answers.where(F.col("kind") == ASKED).select("kind", "part", "batch", "n", "blob").unionByName(of(BATCH))
    tasks = max(default, -(-size // BATCH_BYTES))
    together = both.repartition(tasks, "batch").sortWithinPartitions("batch", F.col("kind") == BATCH, "part")
    return together.mapInArrow(tidy(score_batches(spark.sparkContext.broadcast(model), tokens, words, vocabulary["bos"])), SCORED)
