"""SimHash near-deduplication with pivot distance tables.

Fingerprints are reduced to different ones first. A stored table holds, for each of them, its Hamming
distances to sixteen reference fingerprints (pivots). Two fingerprints within the limit differ by at most
the limit in each coordinate of the table, so a pair with a larger difference in any is discarded unseen,
and only the survivors are verified bit by bit.

Which pairs are looked at is told by pivots too: the 64 bits are cut into six blocks with eight pivots
each, and fingerprints that differ in at most four bits agree in at least two of six blocks, where all
their pivot distances are equal. So they meet under one of the fifteen keys made of the distances in two
blocks, in the order of the first coordinate, and each is held only against those within the limit there.
A key's rows give a spanning forest of their links, not all pairs. Keys with many rows are split by
further tables, with other pivots over shuffled bits, without losing any pair, until none has many or
the rows under a key are near each other in all of them.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows
are rows of their own with equal results; null ids never become a component's id unless all are null;
an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ambiguous_ids, bounded_batches, numbered_rows, staged, text_or_empty, tidy, without_ids
from .components import components, join_hot

BLOCKS, REFERENCES, LIMIT = 6, 8, 4
#: Keys with more rows are split by a further table, up to so many times.
HOT_ROWS, SPLITS = 10_000, 3
#: Up to this size a key's links are found by comparing neighbours at every distance, all keys at once.
SMALL = 32
#: Up to this size all pairs of a key are compared in one matrix.
MATRIX = 1024
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of one text: majority bits of XXH64 over shingles of ``width`` words, repeats included."""
    return wide_fingerprint(text, width, 1)[0]


def wide_fingerprint(text: str, width: int, words: int) -> list[int]:
    """SimHash of ``words`` times 64 bits; further words come from the shingles' hashes, mixed anew."""
    import xxhash

    body = b" ".join(text.encode().lower().split())
    if not body:
        return [0] * words
    data = np.frombuffer(body, np.uint8)
    gaps = np.flatnonzero(data == 32)
    hash64 = xxhash.xxh64_intdigest
    if len(gaps) < width:
        starts, ends = [0], [len(body)]
    else:
        starts = np.concatenate(([0], gaps + 1))[: len(gaps) + 2 - width].tolist()
        ends = np.concatenate((gaps, [len(body)]))[width - 1 :].tolist()
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([hash64(body[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")
        for word in range(words):
            ones[word] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(32)
    return [sum(1 << int(bit) for bit in np.flatnonzero(2 * row > len(starts))) for row in ones]


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long), and fp1, fp2... for further words."""
    names = word_names(words)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([wide_fingerprint(t.as_py(), width, words) for t in batch.column(1)], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(words))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def word_names(words: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, words))]


def pivots(seed: int, blocks: int = BLOCKS) -> list[tuple[int, list[int]]]:
    """Blocks of bits (as masks) and the reference fingerprints of each, within its mask."""
    rng = random.Random(seed)
    bits = list(range(64))
    if seed:
        rng.shuffle(bits)
    masks = [sum(1 << b for b in bits[i::blocks]) for i in range(blocks)]
    return [(mask, [rng.getrandbits(64) & mask for _ in range(REFERENCES)]) for mask in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_pivot_keys(rows: DataFrame, fp: str, seed: int, *more: str, blocks: int = BLOCKS) -> DataFrame:
    """Each row once for every key: for every two blocks (of six: fifteen keys), a hash of their pivot
    distances (four bits each) and of ``more``. Columns: key and those of ``rows``."""
    tables = []
    for b, (mask, references) in enumerate(pivots(seed, blocks)):
        cell = F.lit(0).cast("long")
        for j, reference in enumerate(references):
            distance = F.bit_count((F.col(fp).bitwiseXOR(F.lit(_signed(reference)))).bitwiseAND(F.lit(_signed(mask))))
            cell = cell.bitwiseOR(F.shiftleft(distance.cast("long"), 4 * j))
        tables.append(cell.alias(f"table{b}"))
    keys = [F.xxhash64(F.lit(fp), F.lit(t), F.col(f"table{i}"), F.col(f"table{j}"), *more) for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    wide = rows.select("*", *tables)
    return wide.select(F.explode(F.array(*keys)).alias("new_key"), *rows.columns).drop("key").withColumnRenamed("new_key", "key")


#: Whole reference fingerprints, whose distances are the coordinates of the pivot table.
WHOLE = [random.Random(1000 + j).getrandbits(64) for j in range(16)]


def pivot_table(different: DataFrame) -> DataFrame:
    """fp, low, high: the distances of each fingerprint to all of ``WHOLE``, a byte each, in two longs."""
    halves = []
    for part in (WHOLE[:8], WHOLE[8:]):
        cell = F.lit(0).cast("long")
        for j, reference in enumerate(part):
            cell = cell.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(reference)))).cast("long"), 8 * j))
        halves.append(cell)
    return different.select("fp", halves[0].alias("low"), halves[1].alias("high"))


def coordinates(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of the pivot table as (n, 16) distances."""
    return np.stack((low, high), axis=1).astype("<i8").view(np.int8).reshape(-1, 16)


def survivors(one: np.ndarray, other: np.ndarray, limit: int = LIMIT, table_one: np.ndarray | None = None, table_other: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of rows (n, words) differ in at most ``limit`` bits: first by the largest difference of their
    rows of the pivot table, if given, then bit by bit."""
    at = np.arange(len(other))
    one = np.broadcast_to(one, other.shape)
    if table_other is not None:
        table_one = np.broadcast_to(table_one, table_other.shape)
        for j in range(table_other.shape[1]):
            at = at[np.abs(table_one[at, j] - table_other[at, j]) <= limit]
    keep = np.zeros(len(other), bool)
    distance = np.zeros(len(at), np.int32)
    for word in range(other.shape[1]):  # word by word, with those that are still near
        distance += np.bitwise_count(one[at, word] ^ other[at, word])
        near = distance <= limit
        at, distance = at[near], distance[near]
    keep[at] = True
    return keep


def forest(fps: np.ndarray, limit: int = LIMIT, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places a, b) of a spanning forest of the links among fingerprints (n, words): grows each
    component by comparing a member with all that no component has yet."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = survivors(fps[x], fps[left], limit, *(() if table is None else (table[x], table[left])))
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _run_links(fps: np.ndarray, limit: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in one key's rows, in order of the first coordinate: all pairs that this leaves at once if the rows are few, else a forest."""
    if len(fps) > MATRIX:
        return forest(fps, limit, table)
    first, n = table[:, 0], np.arange(len(fps))
    many = np.searchsorted(first, first + limit, "right") - n - 1
    i = np.repeat(n, many)
    j = i + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    near = survivors(fps[i], fps[j], limit, table[i], table[j])
    return i[near], j[near]


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: every id but the smallest of each connected set, with that smallest one. What many
    keys find of one group comes out as the same few links."""
    names, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)  # roots follow their members
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(len(names)))
    return names[node], names[label[node]]


def key_links(limit: int):
    """Links within runs of equal keys; batches (key, fp, low, high) come sorted by key and first coordinate."""

    def links(keys: np.ndarray, ids: np.ndarray, table: np.ndarray) -> pa.RecordBatch | None:
        fps = ids.view(np.uint64)[:, None]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((edge, [len(keys)])))
        a, b = [], []
        size_at = np.repeat(sizes, sizes)
        small = np.flatnonzero((size_at > 1) & (size_at <= SMALL))
        k, first = keys[small], table[small, 0]
        for gap in range(1, SMALL):
            if gap >= len(k) or not (same := (k[gap:] == k[:-gap]) & (first[gap:] - first[:-gap] <= limit)).any():
                break
            at = np.flatnonzero(same)
            x, y = small[at], small[at + gap]
            near = survivors(fps[x], fps[y], limit, table[x], table[y])
            a.append(x[near])
            b.append(y[near])
        for start, size in zip(edge[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            x, y = _run_links(fps[start : start + size], limit, table[start : start + size])
            a.append(x + start)
            b.append(y + start)
        if not a or not sum(map(len, a)):
            return None
        node, root = local_components(ids[np.concatenate(a)], ids[np.concatenate(b)])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, table = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 16), np.int8)
        for batch in batches:
            column = lambda i, b=batch: b.column(i).to_numpy(zero_copy_only=False)
            keys, ids = np.concatenate((keys, column(0))), np.concatenate((ids, column(1)))
            table = np.concatenate((table, coordinates(column(2), column(3))))
            if len(keys) < CHUNK:
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                if (out := links(keys[:cut], ids[:cut], table[:cut])) is not None:
                    yield out
                keys, ids, table = keys[cut:], ids[cut:], table[cut:]
        if len(keys) and (out := links(keys, ids, table)) is not None:
            yield out

    return run


def fingerprint_links(different: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints of column ``fp`` (different ones) within LIMIT bits."""
    columns = ("key", "fp", "low", "high")
    table = staged(pivot_table(different), "pivot-table")
    keyed = staged(with_pivot_keys(table, "fp", 0).select(*columns), "pivot-keys")
    for seed in range(1, 1 + SPLITS):
        crowded = staged(keyed.groupBy("key").count().where(F.col("count") > HOT_ROWS).select("key"), "crowded-keys")
        if crowded.isEmpty():
            break
        split = with_pivot_keys(keyed.join(crowded, "key"), "fp", seed, "key").select(*columns)  # at most 15 * rows / HOT_ROWS keys
        keyed = staged(keyed.join(crowded, "key", "left_anti").unionByName(split), "pivot-keys")
    ordered = keyed.repartition("key").sortWithinPartitions("key", F.col("low").bitwiseAND(F.lit(255)), "fp")
    return ordered.select(*columns).mapInArrow(tidy(key_links(LIMIT)), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id, component_size."""
    rows = staged(fingerprints(docs, width, 1, id_col, text_col), "fingerprints")
    different = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "different")
    member = staged(components(fingerprint_links(different)), "members")
    joined = different.join(member, different["fp"] == member["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("component_size"), F.count(F.lit(1)).alias("members"))
    labelled = join_hot(joined.select("root", "fp", "copies"), roots, "root", "members", different.count())
    out = join_hot(rows, labelled.select("fp", "copies", "component_id", "component_size"), "fp", "copies", rows.count())
    return out.select("doc_id", "fp", "component_id", "component_size")


def hex_fingerprint(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: Similar documents: candidates agree in two of eight blocks of any of the four words, and differ in at most 64 of 256 bits.
#: At a Jaccard similarity of 0.8 two fingerprints of sets differ in 15 % of their bits, 39 of 256 with a deviation of 6,
#: and share a key with a chance of 99 %; at 0.9 in 26 bits. Every candidate is then verified by its shingles.
SIMILAR_WORDS, SIMILAR_BLOCKS, SIMILAR_LIMIT = 4, 8, 64
#: The least Jaccard similarity of linked documents, as a fraction.
SIMILAR_SHARE = (4, 5)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The different XXH64 hashes of a text's shingles, in order. A text of fewer words is one shingle; one without words has none."""
    import xxhash

    body = b" ".join(text.encode().lower().split())
    if not body:
        return np.empty(0, "<u8")
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    if len(gaps) < width:
        return np.array([xxhash.xxh64_intdigest(body, 42)], "<u8")
    starts, ends, out = np.concatenate(([0], gaps + 1))[: len(gaps) + 2 - width], np.concatenate((gaps, [len(body)]))[width - 1 :], []
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        out.append(np.array([xxhash.xxh64_intdigest(body[a:b], 42) for a, b in pairs], "<u8"))
    return np.unique(np.concatenate(out))


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` times 64 bits of a set of shingles: each counts once, as in the Jaccard similarity."""
    out = np.zeros(words, np.uint64)
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        for word in range(words):
            ones[word] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            part = (part ^ (part >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(32)
    for word in range(words):
        out[word] = np.packbits(2 * ones[word] > len(hashes), bitorder="little").view("<u8")[0]
    return out


def shingled(docs: DataFrame, width: int, words: int) -> DataFrame:
    """Of (doc_id, text): doc_id, node (a hash of the shingle set) and the set's fingerprint, or with no ``words`` the node and the set."""
    names = word_names(words) if words else []
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that sets of few texts are held at once
                some = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), width) for t in some.column(1)]
                node = pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64))
                if words:
                    fps = np.stack([set_fingerprint(x, words) for x in sets]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([some.column(0), node, *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(words))], ["doc_id", "node", *names])
                else:
                    yield pa.RecordBatch.from_arrays([node, pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    shape = ", ".join(["doc_id long", "node long", *(f"{n} long" for n in names)]) if words else "node long, shingles binary"
    return docs.mapInArrow(tidy(run), shape)


def _first_near(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of near pairs in one key's rows: for each row its first near row, so that every row that has one is named."""
    if len(fps) > MATRIX:
        return forest(fps, limit)
    a, b, named = [], [], np.zeros(len(fps), bool)
    for x in range(len(fps) - 1):
        other = np.arange(x + 1, len(fps))
        other = other[~named[other]] if named[x] else other
        near = other[survivors(fps[x], fps[other], limit)] if len(other) else other
        if len(near):
            new = near[~named[near]]
            near = new if len(new) else near[:1]
            named[near] = named[x] = True
        a.append(np.full(len(near), x))
        b.append(near)
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def by_runs(work, columns: int, convert=lambda x: x):
    """A mapInArrow function over batches sorted by their first column: ``work(*columns)`` on whole runs of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
            held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            if len(held[0]) < CHUNK:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            if cut:
                if (out := work(*(c[:cut] for c in held))) is not None:
                    yield out
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]) and (out := work(*held)) is not None:
            yield out

    return run


def _pair_batch(one: np.ndarray, other: np.ndarray) -> pa.RecordBatch | None:
    if not len(one):
        return None
    found = np.unique(np.stack((np.minimum(one, other), np.maximum(one, other)), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], ["a", "b"])


def key_pairs(words: int, limit: int):
    """Candidate pairs (a, b), a < b, within runs of equal keys of (key, id, words...): of each row its first near row."""

    def pairs(keys: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch | None:
        fps = np.stack([c.view(np.uint64) for c in columns], axis=1)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((edge, [len(keys)])))
        size_at = np.repeat(sizes, sizes)
        small = np.flatnonzero((size_at > 1) & (size_at <= SMALL))
        k, a, b = keys[small], [], []
        for gap in range(1, SMALL):
            if gap >= len(k) or not (same := k[gap:] == k[:-gap]).any():
                break
            at = np.flatnonzero(same)
            at = at[survivors(fps[small[at]], fps[small[at + gap]], limit)]
            a.append(small[at])
            b.append(small[at + gap])
        if a:  # for each row its first near row
            x, y = np.concatenate(a), np.concatenate(b)
            first = np.full(len(keys), len(keys))
            np.minimum.at(first, y, x)
            np.minimum.at(first, x, y)
            x = np.flatnonzero(first < len(keys))
            a, b = [first[x]], [x]
        for start, size in zip(edge[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            x, y = _first_near(fps[start : start + size], limit)
            a.append(x + start)
            b.append(y + start)
        return _pair_batch(ids[np.concatenate(a)], ids[np.concatenate(b)]) if a else None

    return by_runs(pairs, 2 + words)


def candidates(nodes: DataFrame) -> DataFrame:
    """Different pairs (a, b) of near fingerprints among (id, words...), by which every id that has a near one is named."""
    names = word_names(SIMILAR_WORDS)
    keyed = reduce(DataFrame.unionByName, [with_pivot_keys(nodes, n, 0, blocks=SIMILAR_BLOCKS).select("key", "id", *names) for n in names])
    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(tidy(key_pairs(SIMILAR_WORDS, SIMILAR_LIMIT)), "a long, b long").distinct()


#: Cells of the table of shingle counts by which prefixes are ordered; any order is right, one by frequency is fast.
COUNT_CELLS = 1 << 20


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each cell: COUNT_CELLS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, np.frombuffer(x.as_buffer(), "<u8") % COUNT_CELLS, 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    cells = sets.select("shingles").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNT_CELLS, np.int64)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out


def prefix_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Different pairs (a, b) of sets with different labels that may be similar enough: all that are, and few others.

    Similar sets share a shingle of their prefixes: the rarest ones, one more than a similar set can lack. At the
    first one shared, what is left of both must still be enough. So sets around one template whose similarity is
    too small don't become pairs, as their own shingles come first. Sets without shingles are one node."""
    part, whole = SIMILAR_SHARE
    shared = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets).astype(np.int32))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            rows = [[], [], [], [], []]
            for node, label, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(blob.as_buffer(), "<u8")
                if not len(x):
                    continue
                often = counts[x % COUNT_CELLS]
                order = np.lexsort((x, often))[: len(x) - -(-part * len(x) // whole) + 1]
                place = np.flatnonzero(often[order] > 1)  # what one set only has is shared by none
                for column, values in zip(rows, (x[order[place]].view(np.int64), np.full(len(place), node), np.full(len(place), label), np.full(len(place), len(x)), place)):
                    column.append(values)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], ["key", "id", "label", "size", "place"])

    def pairs(keys, ids, labels, sizes, places) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.append(edge[1:], len(keys))
        left = sizes - places  # how many shingles two sets can share from this one on
        # with the smallest partner of its key: what can't be enough for that is enough for none
        least = np.repeat(sizes[edge], ends - edge)
        least = np.maximum(least, -(-part * sizes // whole))
        alive = (part + whole) * left >= part * (sizes + least)
        a, b = [], []
        for start, end in zip(edge[ends - edge > 1].tolist(), ends[ends - edge > 1].tolist()):
            at = start + np.flatnonzero(alive[start:end])
            for i in range(len(at) - 1):
                x, y = at[i], at[i + 1 :]
                y = y[: np.searchsorted(sizes[y], whole * sizes[x] // part, "right")]  # in order of size
                y = y[((part + whole) * np.minimum(left[x], left[y]) >= part * (sizes[x] + sizes[y])) & (labels[y] != labels[x])]
                a.append(np.full(len(y), ids[x]))
                b.append(ids[y])
        return _pair_batch(np.concatenate(a), np.concatenate(b)) if a else None

    rows = sets.join(labels, sets["node"] == labels["of_node"], "left").select("node", F.coalesce("label", "node").alias("label"), "shingles")
    rows = rows.mapInArrow(tidy(prefixes), "key long, id long, label long, size long, place long").repartition("key").sortWithinPartitions("key", "size", "id")
    return rows.mapInArrow(tidy(by_runs(pairs, 5)), "a long, b long").distinct()


def similar_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, shingles of a, shingles of b) those of enough Jaccard similarity."""
    part, whole = SIMILAR_SHARE
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(whole * common >= part * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets are similar. The smaller node may be in very many pairs."""
    degrees = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    one = degrees.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    both = join_hot(pairs, one, "a", "degree", pairs.count()).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("other")), "b")
    return both.select("a", "b", "one", "other").mapInArrow(tidy(similar_sets), "a long, b long")


def similar_groups(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group_id: documents connected by a Jaccard similarity of 0.8 or more of their word shingles.

    The wide form of ``near_duplicates``: pairs that meet under keys of equal pivot distances and are near
    over all bits are candidates, and linked if their shingle sets are similar. Documents of equal sets are
    one node; texts without words are grouped with each other. First each node is compared with its first
    near one of every key; then the nodes that have a near one are joined by the prefixes of their sets, leaving out
    what is connected. So a large group takes few pairs, and no similar pair of such nodes is missed.
    """
    names = word_names(SIMILAR_WORDS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = staged(shingled(texts, width, SIMILAR_WORDS), "wide-fingerprints")
    n = rows.count()  # tables of about so many rows are written in as few files as these need
    different = staged(rows.groupBy("node", *names).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "wide-different", rows=n)
    pairs = staged(candidates(different.select(F.col("node").alias("id"), *names)), "wide-pairs", rows=n)
    near = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(different, "node"), "wide-near", rows=n)
    wanted = near.select(F.col("first").alias("doc_id")).distinct()
    some = texts.join(wanted, "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))  # a set may have rows without ids only
    sets = staged(shingled(some, width, 0).join(near.select("node"), "node", "left_semi").dropDuplicates(["node"]), "wide-sets")
    labels = staged(components(verified(pairs, sets), rows=n), "wide-labels", rows=n).select(F.col("node").alias("m"), "root")
    more = staged(prefix_pairs(sets, labels.select(F.col("m").alias("of_node"), F.col("root").alias("label"))).join(pairs, ["a", "b"], "left_anti"), "wide-more", rows=n)
    joined = different.select("node", "first", "copies").join(labels, F.col("node") == F.col("m"), "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    if not more.isEmpty():  # links between the groups so far
        more, of = verified(more, sets), labels.select(F.col("m").alias("of"), "root")
        for side in ("a", "b"):
            more = more.join(of, F.col(side) == F.col("of"), "left").withColumn(side, F.coalesce("root", side)).drop("of", "root")
        merged = components(more, rows=n).select(F.col("node").alias("old"), F.col("root").alias("new"))
        joined = joined.join(merged, F.col("root") == F.col("old"), "left").select("node", "first", "copies", F.coalesce("new", "root").alias("root"))
    joined = staged(joined, "wide-joined", rows=n)
    roots = joined.groupBy("root").agg(F.min("first").alias("group_id"), F.count(F.lit(1)).alias("members"))
    labelled = join_hot(joined.select("root", "node", "copies"), roots, "root", "members", joined.count())
    return join_hot(rows.select("doc_id", "node"), labelled.select("node", "copies", "group_id"), "node", "copies", n).select("doc_id", "group_id")


def without_similar(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without all but the smallest id of each group of similar documents. If ids repeat or are null,
    rows are numbered as they are stored, and the first one of a group stays."""
    columns, number = docs.columns, id_col
    if ambiguous_ids(docs, id_col):
        docs, number = numbered_rows(docs)
    groups = similar_groups(docs, width, number, text_col)
    return without_ids(docs, groups.where("doc_id <> group_id").select(F.col("doc_id").alias("gone")), number).select(*[f"`{c}`" for c in columns])
