"""SentencePiece BPE encoding through a prefix table, and decoding.

For every prefix of a stretch of text the table stores the one last token that the merge procedure
ends with. The candidates are the vocabulary pieces that end there, found by an Aho-Corasick
automaton; the right one is the piece that is compatible with the last token of the prefix before
it, that is, whose neighbour would not have merged across the border. The ids are then recovered
from the end backwards. The table is linear in the text; nothing is merged at run time.

Stretches are the runs between places where no piece can cross (a space mark after other characters,
and characters outside the vocabulary), so results of short stretches are remembered, up to a bound.

Defined cases: null text counts as empty and has only the begin and end ids; characters outside the
vocabulary become byte pieces; rows are independent, so ties, repeats and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, text_or_empty, tidy, worker_cache

SPACE = "▁"
#: Bounds of what a worker remembers: stretches (and their length), and tested pairs.
MEMO, MEMO_LENGTH, PAIRS = 120_000, 64, 200_000
#: In place of a token's id: the start of a stretch, or a character outside the vocabulary.
NONE = -1


def merged(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """The merge procedure itself, on a short text: best rank first, leftmost first. Builds the split table."""
    symbols = list(symbols)
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, islice(symbols, 1, None))) if a + b in rank), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def split_of(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last merge that makes ``piece`` out of its characters; None if merging never makes it."""
    symbols = list(piece)
    while len(symbols) > 2:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, islice(symbols, 1, None))) if a + b in rank), default=None)
        if best is None:
            return None
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return (symbols[0], symbols[1]) if len(symbols) == 2 and "".join(symbols) in rank else None


def load_vocabulary(path: str) -> dict:
    """Plain tables of a SentencePiece BPE model with byte fallback; small, so they can be broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    pieces = [model.id_to_piece(i) for i in range(n)]
    order = sorted((i for i in range(n) if i not in special), key=lambda i: (-model.get_score(i), i))
    rank = {pieces[i]: r for r, i in enumerate(order) if len(pieces[i]) > 1}
    splits = {p: s for p in rank if (s := split_of(p, rank))}
    return {
        "pieces": pieces, "special": special, "rank": rank, "splits": splits,
        "bytes": {int(pieces[i][3:5], 16): i for i in special if model.is_byte(i)},
        "control": {i for i in special if model.is_control(i)}, "unknown": model.unk_id(), "bos": model.bos_id(), "eos": model.eos_id(),
    }


class _Memo(dict):
    """Encoded short stretches in two generations: when the young one is full it becomes the old one,
    and what is asked for again moves back, so that common words stay."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.old.get(stretch) or self.encode(stretch)
        if len(stretch) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


class _Fits(dict):
    """Whether a piece may follow a token, by the token's id. What is not known yet is tested and remembered; NONE always fits."""

    __slots__ = ("codec", "piece")

    def __init__(self, codec: Codec, piece: str) -> None:
        super().__init__()
        self.codec, self.piece = codec, piece
        self[NONE] = True

    def __missing__(self, before: int) -> bool:
        codec = self.codec
        if codec.tested >= PAIRS:
            codec.forget_pairs()
        codec.tested += 1
        ok = self[before] = codec._compatible(codec.pieces[before], self.piece)
        return ok


class Codec:
    def __init__(self, vocabulary: dict) -> None:
        import ahocorasick

        pieces, special, rank, splits = (vocabulary[k] for k in ("pieces", "special", "rank", "splits"))
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and (len(p) == 1 or p in splits)}
        self.pieces, self.rank, self.splits, self.byte_ids = pieces, rank, splits, vocabulary["bytes"]
        self.bos, self.eos = np.uint32([vocabulary["bos"]]).tobytes(), np.uint32([vocabulary["eos"]]).tobytes()
        self.automaton = ahocorasick.Automaton()
        self.fits = [_Fits(self, p) for p in self.ids]
        self.tested = 0
        for fits in self.fits:
            self.automaton.add_word(fits.piece, (self.ids[fits.piece], len(fits.piece), fits))
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in pieces]
        self.packed_ids = [i.to_bytes(4, "little") for i in range(len(pieces))]
        crossing = {c for p in self.ids for c in p}
        outside = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in crossing)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that hold a space mark inside are not supported")
        self.stretches = re.compile(rf"[{outside}]|{SPACE}*[^{SPACE}{outside}]+|{SPACE}+").findall
        self.memo = _Memo(self._encode_stretch)
        self.shown = [b"" if i in vocabulary["control"] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for byte, i in self.byte_ids.items():
            self.shown[i] = bytes([byte])
        self.shown[vocabulary["unknown"]] = " ⁇ ".encode()
        self.byte_set, self.control = frozenset(self.byte_ids.values()), vocabulary["control"]
        self.silent = np.zeros(len(pieces), bool)
        self.silent[list(self.control)] = True

    def _compatible(self, a: str, b: str) -> bool:
        """Would merging leave a border between tokens a and b? Undoes the merges at the border, latest
        first, and looks for a merge across it that would have come before the one undone."""
        rank, splits = self.rank, self.splits
        limit = len(rank) + 1
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, splits[a][1]
            else:  # at equal rank the merge further left, across the border, would have come first
                limit, b = rb + 1, splits[b][0]

    def forget_pairs(self) -> None:
        self.tested = 0
        for fits in self.fits:
            fits.clear()
            fits[NONE] = True

    def _encode_stretch(self, text: str) -> bytes:
        last = [NONE] * (len(text) + 1)
        for end, (token, length, fits) in self.automaton.iter(text):  # by end, the longest first
            end += 1
            if last[end] < 0 and fits[last[end - length]]:
                last[end] = token
        lengths, packed_ids = self.lengths, self.packed_ids
        out: list[bytes] = []
        at = len(text)
        while at:
            token = last[at]
            if token >= 0:
                out.append(packed_ids[token])
                at -= lengths[token]
            else:
                out.extend(packed_ids[self.byte_ids[x]] for x in reversed(text[at - 1].encode()))
                at -= 1
        out.reverse()
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text with begin and end ids."""
        if not text:
            return np.frombuffer(self.bos + self.eos, "<u4")
        body = self.stretches(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join((self.bos, *map(self.memo.__getitem__, body), self.eos)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: control ids are silent, the first piece loses its space mark, and bytes
        that are no UTF-8 become one replacement character each."""
        inside = self.silent[ids[1:-1]].any()
        ids = ids.tolist()
        if inside:  # a control id ends a run of byte pieces
            parts, rest = [], ids
            while cut := next((k for k, i in enumerate(rest) if i in self.control and 0 < k), 0):
                parts.append(rest[:cut])
                rest = rest[cut:]
            texts = [self._show(part) for part in (*parts, rest)]
            return self._strip(ids, "".join(texts))
        return self._strip(ids, self._show(ids))

    def _strip(self, ids: list[int], text: str) -> str:
        first = next((i for i in ids if i not in self.control), None)
        if first is not None and first not in self.byte_set and self.pieces[first].startswith(SPACE):
            return text[1:]
        return text

    def _show(self, ids: list[int]) -> str:
        raw = b"".join(map(self.shown.__getitem__, ids))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._lenient(raw)

    @staticmethod
    def _lenient(raw: bytes) -> str:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def worker_codec(vocabulary) -> Codec:
    """One codec for each Python worker, so that what it remembers serves later tasks."""
    cache = worker_cache()
    if "piece_codec" not in cache or cache["piece_codec"][0] != vocabulary.value["pieces"]:
        cache["piece_codec"] = (vocabulary.value["pieces"], Codec(vocabulary.value))
    return cache["piece_codec"][1]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every row of ``docs``, encoded."""
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(tidy(run, ("piece_codec",)), "doc_id long, ids array<int>")


def decoded(encoded_docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text: the texts of rows (doc_id, ids)."""
    vocabulary = encoded_docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary)
        for batch in batches:
            texts = [codec.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(tidy(run, ("piece_codec",)), "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, digests only,
    so that the id arrays never travel between Python and the JVM."""
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                rows.append((len(ids), sha(ids.data).hexdigest(), sha(codec.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidy(run, ("piece_codec",)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
