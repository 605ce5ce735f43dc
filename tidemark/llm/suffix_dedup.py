"""Suffix-array deduplication of exact byte strings by prefix-free parsing, spread over the cluster.

Parsing. A rolling hash of K bytes slides over every text. Each string of LENGTH bytes has one trigger:
its K bytes of smallest hash (the leftmost at a tie), which depends on its content only. Neighbouring
strings with one trigger make a phrase, so the phrases of a text overlap by LENGTH - 1 bytes, are
prefix-free in the sense that no string of LENGTH bytes lies in two phrases of a text, and equal
strings anywhere lie in phrases with equal triggers, at equal distance to them.

Parse. Phrases go to the task that owns their trigger as (trigger, digest, id, start). Of phrases with
equal content only the earliest in corpus order stays in the dictionary; all strings in the others
start earlier elsewhere. A phrase whose trigger belongs to one content only is done.

Dictionary. What is left, a small share in ordinary text, is fetched as bytes. Its suffixes are ranked
by prefix doubling to a depth of LENGTH bytes; ranks with the parse order (id, start) give the corpus
order of equal strings, whose first one stays. Triggers with very many contents (a common line in many
contexts) are dealt out by string instead, with 128-bit hashes, so they meet in no single task.

Equal phrases, and equal strings of common triggers, are combined within a batch before any shuffle.
Nothing is sampled or capped; every byte of every text is parsed.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; of rows that repeat an id
none counts as earlier than the other at the same start, and they share their spans; null ids come
last in corpus order; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import collect_garbage, staged, text_or_empty, tidy

K, LENGTH = 32, 100
#: Bytes parsed at once; positions within it take 20 bits of a packed hash.
BUFFER, POSITION = 900_000, 20
#: Triggers with more different contents are dealt out by string.
COMMON = 1000
#: Bytes of text a task of the shuffles gets.
PER_TASK = 12_000_000
LAST = (1 << 63) - 1
SPANS, REQUESTS, PHRASES, WINDOWS, TEXTS = range(5)
ROW = "part int, kind int, blob binary"
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns)


def unpack(blobs: list[bytes], *dtypes: str) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.empty(0, d)] for d in dtypes]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for part, dtype in zip(parts, dtypes):
            part.append(np.frombuffer(blob, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
    return [np.concatenate(part) for part in parts]


PHRASE = ("u8", "u8", "i8", "i4", "u1")
SPAN = ("i8", "i4", "i4")
REQUEST = ("u8", "i8", "i4", "u1", "u1")
WINDOW = ("u8", "u8", "i8", "i4")


def dealt(part: np.ndarray, kind: int, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """Rows (part, kind, blob): the columns split by part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cuts[1:], len(part))
    columns = [c[order] for c in columns]
    return [(int(part[a]), kind, pack(*(c[a:b] for c in columns))) for a, b in zip(cuts.tolist(), ends.tolist())]


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])


def doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 15), parts)


def doc_part_column(doc_id: str, parts: int) -> Column:
    c = F.coalesce(F.col(doc_id), F.lit(LAST))
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 15)), F.lit(parts)).cast("int")


def trigger_part(trigger: np.ndarray, parts: int) -> np.ndarray:
    return ((trigger * _M[1]) >> np.uint64(33)).astype(np.int64) % parts


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes at every position."""
    wide = data.astype(np.uint64)
    for shift in (1, 2, 4):
        wide = wide[:-shift] | (wide[shift:] << np.uint64(8 * shift))
    n = len(data) - K + 1
    h = wide[:n] * _M[0]
    for at in range(8, K, 8):
        h ^= h >> np.uint64(31)
        h += wide[at : at + n]
        h *= _M[1]
    return h ^ (h >> np.uint64(32))


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def parse(pieces: list[tuple[int, int, bytes]]) -> list[np.ndarray] | None:
    """Phrases of pieces (id, offset, bytes): trigger, digest, id, start, number of strings."""
    import xxhash

    buffer = b"".join(p[2] for p in pieces)
    if len(buffer) < LENGTH:
        return None
    hashes = rolling_hash(np.frombuffer(buffer, np.uint8))
    places = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(POSITION)
    triggers = (window_minimum((hashes >> low << low) | places, LENGTH - K + 1) & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(triggers)]
    first = np.flatnonzero((np.diff(triggers, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    stop = np.append(first[1:], len(triggers))
    inside = first + LENGTH <= ends[owner[first]]
    first, stop = first[inside], stop[inside]
    stop = np.minimum(stop, ends[owner[first]] - LENGTH + 1)
    view, digest64 = memoryview(buffer), xxhash.xxh3_64_intdigest
    digests = np.array([digest64(view[a:b]) for a, b in zip(first.tolist(), (stop + LENGTH - 1).tolist())], np.uint64)
    at = triggers[first]
    digests ^= (at - first).astype(np.uint64) * _M[0]
    ids, offsets = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    who = owner[first]
    return [hashes[at], digests, ids[who], (first - (ends - sizes)[who] + offsets[who]).astype(np.int32), (stop - first).astype(np.uint8)]


def earliest(group: list[np.ndarray], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by group, id, start; whether an element is the first of its group, and whether it is later than that."""
    order = np.lexsort((starts, ids, *reversed(group)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in group:
        g = g[order]
        new[1:] |= g[1:] != g[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.empty(0, np.int64)
    i, s = ids[order], starts[order]
    return order, new, (i != i[head]) | (s != s[head])


def text_pieces(ids: list, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Buffers of pieces; a text longer than a buffer is cut with an overlap, so that no string is lost."""
    pieces, size = [], 0
    for doc_id, text in zip(ids, texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BUFFER):
            piece = text[at : at + BUFFER + LENGTH - 1]
            if size + len(piece) > BUFFER + LENGTH and pieces:
                yield pieces
                pieces, size = [], 0
            pieces.append((LAST if doc_id is None else doc_id, at, piece))
            size += len(piece)
    if pieces:
        yield pieces


def phrase_rows(parts: int):
    """Documents (doc_id, text) to phrase rows by trigger and span rows by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [p for pieces in text_pieces(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) if (p := parse(pieces))]
            if not parsed:
                continue
            phrases = [np.concatenate(c) for c in zip(*parsed)]
            yield rows(combined(phrases, parts))

    def combined(phrases: list[np.ndarray], parts: int) -> list:
        trigger, digest, ids, starts, n = phrases
        order, new, later = earliest([trigger, digest], ids, starts)
        keep, gone = order[~later], order[later]
        out = dealt(trigger_part(trigger[keep], parts), PHRASES, [c[keep] for c in phrases])
        return out + span_rows(ids[gone], starts[gone], starts[gone] + n[gone] + (LENGTH - 1), parts)

    return run


def span_rows(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, parts: int) -> list:
    """Rows of spans by document; spans of a document that touch are joined."""
    if not len(ids):
        return []
    order = np.lexsort((starts, ids))
    ids, starts, stops = ids[order], starts[order].astype(np.int32), stops[order].astype(np.int32)
    where = np.cumsum(np.diff(ids, prepend=ids[0]) != 0)
    reach = np.maximum.accumulate(stops.astype(np.int64) + (where.astype(np.int64) << 32)) - (where.astype(np.int64) << 32)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return dealt(doc_part(ids[first], parts), SPANS, [ids[first], starts[first], reach[last].astype(np.int32)])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Rows sorted by part, gathered part by part: kind to blobs."""
    part, blobs = None, {}
    for batch in batches:
        for p, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if p != part:
                if blobs:
                    yield part, blobs
                part, blobs = p, {}
            blobs.setdefault(kind, []).append(blob.as_py())
    if blobs:
        yield part, blobs


def resolve_phrases(parts: int):
    """Phrases of a trigger to spans of later copies and requests for contents that share a trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(batches):
            out = [(part, SPANS, blob) for blob in blobs.get(SPANS, ())]
            if PHRASES in blobs:
                out += resolved(*unpack(blobs[PHRASES], *PHRASE))
            yield rows(out)

    def resolved(trigger, digest, ids, starts, n) -> list:
        order, new, later = earliest([trigger, digest], ids, starts)
        gone = order[later]
        out = span_rows(ids[gone], starts[gone], starts[gone] + n[gone] + (LENGTH - 1), parts)
        heads = order[new]
        t = trigger[heads]
        edge = np.flatnonzero(np.diff(t, prepend=~t[:1]) != 0) if len(t) else np.empty(0, np.int64)
        many = np.diff(np.append(edge, len(t)))
        many = np.repeat(many, many)
        ask = heads[many > 1]
        common = (many[many > 1] > COMMON).astype(np.uint8)
        return out + dealt(doc_part(ids[ask], parts), REQUESTS, [trigger[ask], ids[ask], starts[ask], n[ask], common])

    return run


def with_texts(work: DataFrame, docs: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Work rows and texts of each part together, the work first."""
    texts = docs.select(doc_part_column("doc_id", parts).alias("part"), F.lit(TEXTS).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc_id", F.encode("text", "UTF-8").alias("text"))
    both = work.select("part", "kind", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text")).unionByName(texts)
    return both.repartitionById(tasks, "part").sortWithinPartitions("part", "kind")


def documents_with(batches: Iterator[pa.RecordBatch], *dtypes: str) -> Iterator[tuple[object, bytes, list[np.ndarray]]]:
    """(id, text, its work columns) of every document; the work's first column of longs is the id."""
    key = list(dtypes).index("i8")
    part, blobs, columns = None, [], None
    for batch in batches:
        cells = [batch.column(i).to_pylist() for i in (0, 1)]
        for row, (p, kind) in enumerate(zip(*cells)):
            if p != part:
                part, blobs, columns = p, [], None
            if kind != TEXTS:
                blobs.append(batch.column(2)[row].as_py())
                continue
            if columns is None:
                columns = unpack(blobs, *dtypes)
                order = np.argsort(columns[key], kind="stable")
                columns, blobs = [c[order] for c in columns], []
            doc_id = batch.column(3)[row].as_py()
            k = LAST if doc_id is None else doc_id
            a, b = np.searchsorted(columns[key], (k, k + 1)) if k < LAST else (np.searchsorted(columns[key], k), len(columns[key]))
            yield doc_id, batch.column(4)[row].as_py(), [c[a:b] for c in columns]


def fetch_phrases(parts: int):
    """Texts and requests to dictionary rows: phrases with their bytes, or hashes of their strings for common triggers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, contents, size = [], [], 0
        for _, text, (trigger, ids, starts, n, common) in documents_with(batches, *REQUEST):
            if not len(ids):
                continue
            asked.append((trigger, ids, starts, n, common))
            contents += [text[a : a + m + LENGTH - 1] for a, m in zip(starts.tolist(), n.tolist())]
            size += len(contents[-1]) * len(ids)
            if size > 16_000_000:
                yield rows(dictionary(asked, contents))
                asked, contents, size = [], [], 0
        if asked:
            yield rows(dictionary(asked, contents))

    def dictionary(asked: list, contents: list[bytes]) -> list:
        import xxhash

        trigger, ids, starts, n, common = (np.concatenate(c) for c in zip(*asked))
        out = []
        plain = np.flatnonzero(common == 0)
        part = trigger_part(trigger[plain], parts)
        for p in np.unique(part).tolist():
            at = plain[part == p]
            out.append((p, PHRASES, pack(trigger[at], ids[at], starts[at], n[at]) + b"".join([contents[i] for i in at.tolist()])))
        hot = np.flatnonzero(common)
        if len(hot):
            digest = xxhash.xxh3_128_intdigest
            hashes = [digest(contents[i][k : k + LENGTH]) for i in hot.tolist() for k in range(int(n[i]))]
            high, low = np.array([h >> 64 for h in hashes], np.uint64), np.array([h & (1 << 64) - 1 for h in hashes], np.uint64)
            step = n[hot].astype(np.int64)
            each = np.arange(len(hashes)) - np.repeat(np.cumsum(step) - step, step)
            wid, ws = np.repeat(ids[hot], step), (np.repeat(starts[hot], step) + each).astype(np.int32)
            order, _, later = earliest([high, low], wid, ws)
            keep, gone = order[~later], order[later]
            out += dealt(trigger_part(low[keep], parts), WINDOWS, [high[keep], low[keep], wid[keep], ws[keep]])
            out += span_rows(wid[gone], ws[gone], ws[gone] + LENGTH, parts)
        return out

    return run


def suffix_ranks(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks, in byte order, of the LENGTH bytes at ``places``: prefix doubling from 8 bytes on."""
    wide = np.zeros(len(data), np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for k in range(8):
        wide |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    rank = np.unique(wide, return_inverse=True)[1].astype(np.uint64)
    depth = 8
    while 2 * depth <= LENGTH:
        second = np.concatenate((rank[depth:], np.zeros(min(depth, len(rank)), np.uint64)))
        rank = np.unique((rank << np.uint64(32)) | second, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
    return np.unique((rank[places] << np.uint64(32)) | rank[places + (LENGTH - depth)], return_inverse=True)[1]


def resolve_dictionary(parts: int):
    """Dictionary rows to spans: equal strings by suffix rank, the earliest of each in corpus order stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(batches):
            out = [(part, SPANS, blob) for blob in blobs.get(SPANS, ())]
            if PHRASES in blobs:
                out += ranked(blobs[PHRASES])
            if WINDOWS in blobs:
                high, low, ids, starts = unpack(blobs[WINDOWS], *WINDOW)
                order, _, later = earliest([high, low], ids, starts)
                gone = order[later]
                out += span_rows(ids[gone], starts[gone], starts[gone] + LENGTH, parts)
            yield rows(out)

    def ranked(blobs: list[bytes]) -> list:
        kinds = ("u8", "i8", "i4", "u1")
        heads = [unpack([b], *kinds) for b in blobs]
        data = np.frombuffer(b"".join(b[8 + len(h[0]) * 21 :] for b, h in zip(blobs, heads)), np.uint8)
        _, ids, starts, n = (np.concatenate(c) for c in zip(*heads))
        n = n.astype(np.int64)
        sizes = n + LENGTH - 1
        begin = np.cumsum(sizes) - sizes
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rank = suffix_ranks(data, np.repeat(begin, n) + each)
        wid, ws = np.repeat(ids, n), (np.repeat(starts, n) + each).astype(np.int32)
        order, _, later = earliest([rank], wid, ws)
        gone = order[later]
        return span_rows(wid[gone], ws[gone], ws[gone] + LENGTH, parts)

    return run


def cut(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the bytes that are left."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist())):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return runs, b"".join(kept)


def cut_documents(contents: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for doc_id, text, (_, starts, stops) in documents_with(batches, *SPAN):
            runs, kept = cut(text, starts, stops)
            spans = [{"start": a, "stop": b} for a, b in runs]
            out.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), spans, kept if contents else None))
            size += len(kept) if contents else 200
            if size > 4_000_000:
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def without_repeats(docs: DataFrame, contents: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs), kept (remaining bytes, if ``contents``)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_TASK))
    parts = tasks  # a part is a partition: rows between two steps are at most tasks * parts

    def through(shuffled: DataFrame, step, name: str) -> DataFrame:
        return staged(shuffled.repartitionById(tasks, "part").sortWithinPartitions("part").mapInArrow(tidy(step), ROW), name)

    phrases = through(texts.mapInArrow(tidy(phrase_rows(parts)), ROW), resolve_phrases(parts), "phrases")
    collect_garbage(spark)
    asked = with_texts(phrases.where(F.col("kind") == REQUESTS), texts, parts, tasks)
    ranked = through(asked.mapInArrow(tidy(fetch_phrases(parts)), ROW), resolve_dictionary(parts), "dictionary")
    collect_garbage(spark)
    spans = phrases.where(F.col("kind") == SPANS).unionByName(ranked)
    out = with_texts(spans, texts, parts, tasks).mapInArrow(
        tidy(cut_documents(contents)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>, kept binary"
    )
    return out if contents else out.drop("kept")
