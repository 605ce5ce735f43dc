"""A small causal self-attention model over subword ids, in numpy.

An id's probability is P(class | context) * P(id | class). The class logits of a position are those of
the id before it (from counts over all training texts) plus the output of one attention layer over the
ids before it, which is trained. Texts are laid out in blocks of BLOCK ids. A window is a block and the
block before it; windows overlap by a block, and each scores the ids of its last block only, so every
id is scored once with BLOCK to 2 * BLOCK - 1 ids of context. Many windows make one masked product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK, WIDTH = 16, 16
#: Windows computed at once, so that intermediate results stay in the cache.
AT_ONCE = 32
#: Rows of class logits at once, so that they stay in the cache; exponents whose sums need no shift.
ROWS, PLAIN = 256, 60.0
FAR, TINY = np.float32(-1e9), np.float32(1e-30)
_LAG = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
CAUSAL = np.where(_LAG >= 0, 0, FAR).astype(np.float32)
_LAG = np.maximum(_LAG, 0)
TRAINED = ("embed", "query", "key", "value", "out", "lag")


@dataclass
class Attention:
    classes: np.ndarray  # class of each id
    starts: np.ndarray  # which classes hold ids that begin a word
    within: np.ndarray  # log P(id | class)
    bigram: np.ndarray  # class logits after each id
    weights: dict  # what is trained

    @staticmethod
    def initial(classes: np.ndarray, n_classes: int, seed: int = 7) -> dict:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        return {
            "embed": draw(n_classes, WIDTH)[classes], "query": draw(WIDTH, WIDTH) * 0.1, "key": draw(WIDTH, WIDTH) * 0.1, "value": draw(WIDTH, WIDTH) / 4,
            "out": np.zeros((WIDTH, n_classes), np.float32), "lag": -0.3 * np.arange(2 * BLOCK, dtype=np.float32),
        }

    def score(self, ids: np.ndarray, targets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For inputs (blocks, BLOCK) and their next ids: log P(next id), log P(next id begins a word).
        ``first`` marks blocks that begin a text, which see nothing of the block before."""
        w = self.weights
        n = len(ids)
        score, start = np.empty((n, BLOCK), np.float32), np.empty((n, BLOCK), np.float32)
        project = np.concatenate((w["query"] / np.float32(WIDTH**0.5), w["key"], w["value"]), axis=1)
        qkv_of = np.ones((len(w["embed"]), 3 * WIDTH + 1), np.float32)  # the last column sums the weights
        np.matmul(w["embed"], project, out=qkv_of[:, :-1])
        bias = w["lag"][_LAG] + CAUSAL
        flat_targets = targets.ravel()
        wanted_class, within = self.classes[flat_targets], self.within[flat_targets].reshape(targets.shape)
        sums = np.stack((np.ones(len(self.starts)), self.starts), axis=1).astype(np.float32)  # sums as products: faster on short rows
        room, steepest = plain_room(self.bigram), norm(w["out"], 0)
        qkv = np.empty(((AT_ONCE + 1) * BLOCK, 3 * WIDTH + 1), np.float32)
        qkv[:BLOCK] = 0
        pairs_of = sliding(qkv.reshape(AT_ONCE + 1, BLOCK, -1))
        after, raised = np.empty((2, AT_ONCE * BLOCK, len(self.starts)), np.float32)
        row = np.arange(AT_ONCE * BLOCK) * len(self.starts)
        for at in range(0, n, AT_ONCE):
            block = slice(at, min(at + AT_ONCE, n))
            m = block.stop - at
            here, rows = ids[block].ravel(), slice(at * BLOCK, block.stop * BLOCK)
            np.take(qkv_of, here, axis=0, out=qkv[BLOCK : BLOCK + len(here)], mode="clip")
            pairs = pairs_of[:m]
            a = np.matmul(qkv[BLOCK : BLOCK + len(here), :WIDTH].reshape(m, BLOCK, WIDTH), pairs[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1))
            a += bias
            a[first[block], :, :BLOCK] = FAR
            exponentials(a)
            mixed = np.matmul(a, pairs[:, :, 2 * WIDTH :]).reshape(-1, WIDTH + 1)
            mixed = mixed[:, :WIDTH] * (1 / mixed[:, WIDTH:])
            logits = after[: len(here)]
            np.take(self.bigram, here, axis=0, out=logits, mode="clip")
            logits += np.matmul(mixed, w["out"], out=raised[: len(here)])
            if not norm(mixed, 1) * steepest < room:
                logits -= logits.max(axis=1, keepdims=True)
            wanted = logits.ravel()[row[: len(here)] + wanted_class[rows]]
            np.exp(logits, out=logits)
            total = logits @ sums
            log_total = np.log(total[:, 0])
            score[block] = (wanted - log_total).reshape(m, BLOCK) + within[block]
            start[block] = (np.log(np.maximum(total[:, 1], TINY)) - log_total).reshape(m, BLOCK)
            qkv[:BLOCK] = qkv[m * BLOCK : (m + 1) * BLOCK]
        return score, start


def sliding(blocks: np.ndarray) -> np.ndarray:
    """A view of (blocks, BLOCK, width): each block but the first together with the one before it."""
    m, size, width = blocks.shape
    return np.lib.stride_tricks.as_strided(blocks, (m - 1, 2 * size, width), blocks.strides)


def exponentials(a: np.ndarray) -> None:
    """exp(a) in place for weights whose row i of BLOCK always sees its own id, at BLOCK + i. The rows are only
    shifted to a maximum of zero, which is slow on short rows, if their sums could leave the range of floats."""
    own = a.reshape(-1, 2 * BLOCK * BLOCK)[:, BLOCK :: 2 * BLOCK + 1]
    if not (a.max(initial=0) < PLAIN and own.min(initial=0) > -PLAIN):
        a -= a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)


def norm(x: np.ndarray, axis: int) -> float:
    """The largest length of rows (axis 1) or columns (axis 0)."""
    return float(np.sqrt(np.einsum("ij,ij->i" if axis else "ij,ij->j", x, x).max(initial=0)))


def plain_room(bigram: np.ndarray) -> float:
    """How far logits may be from ``bigram`` so that their exponentials sum up without a shift; negative if never."""
    if not bigram.size:
        return -1.0
    return float(PLAIN - max(bigram.max(), -bigram.max(axis=1).min()))


def gradients(w: dict, bigram: np.ndarray, classes: np.ndarray, ids: np.ndarray, targets: np.ndarray, first: np.ndarray, valid: np.ndarray, room: float | None = None) -> tuple[float, dict]:
    """Loss and gradients on windows: ids (n, 2 * BLOCK), next ids of the last block, which windows begin a text, and
    which next ids count. ``room``: plain_room(bigram), if known.
    The gradient of ``embed`` is (ids, rows): all other rows are zero."""
    n, scale, kind = len(ids), np.float32(WIDTH**0.5), w["embed"].dtype
    room = plain_room(bigram) if room is None else room
    x = np.take(w["embed"], ids, axis=0)
    flat = x.reshape(-1, WIDTH)
    project = np.concatenate((w["query"] / scale, w["key"], w["value"]), axis=1)
    qkv = np.ones((len(flat), 3 * WIDTH + 1), kind)  # the last column sums the weights
    np.matmul(flat, project, out=qkv[:, :-1])
    blocks = qkv.reshape(n, 2 * BLOCK, -1)
    q, k, v = blocks[:, BLOCK:, :WIDTH], blocks[..., WIDTH : 2 * WIDTH], blocks[..., 2 * WIDTH :]
    a = q @ k.swapaxes(1, 2)
    a += w["lag"][_LAG] + CAUSAL
    a[first, :, :BLOCK] = FAR
    exponentials(a)
    mixed = (a @ v).reshape(-1, WIDTH + 1)
    weight = mixed[:, WIDTH:].copy()
    mixed = mixed[:, :WIDTH] / weight
    loss, g_out, g_mixed, pace = class_gradients(w["out"], bigram, mixed, ids[:, BLOCK:].ravel(), classes[targets.ravel()], valid.ravel(), room)
    g = np.empty((len(mixed), WIDTH + 1), kind)  # of the unscaled sums; the last column is what a row's gradients have in common
    np.multiply(g_mixed, pace[:, None] / weight, out=g[:, :WIDTH])
    np.einsum("ij,ij->i", g[:, :WIDTH], mixed, out=g[:, WIDTH])
    np.negative(g[:, WIDTH], out=g[:, WIDTH])
    g = g.reshape(n, BLOCK, WIDTH + 1)
    g_s = g @ v.swapaxes(1, 2)
    g_s *= a
    g_qkv = np.empty((n, 2 * BLOCK, 3 * WIDTH), kind)
    g_qkv[:, :BLOCK, :WIDTH] = 0
    np.matmul(g_s, k, out=g_qkv[:, BLOCK:, :WIDTH])
    np.matmul(g_s.swapaxes(1, 2), q, out=g_qkv[..., WIDTH : 2 * WIDTH])
    np.matmul(a.swapaxes(1, 2), g[..., :WIDTH], out=g_qkv[..., 2 * WIDTH :])
    g_qkv = g_qkv.reshape(-1, 3 * WIDTH)
    g_project = flat.T @ g_qkv
    g_x = g_qkv @ project.T
    every = ids.ravel().astype(np.uint16 if len(w["embed"]) <= 1 << 16 else np.int64)  # short numbers sort faster
    order = np.argsort(every, kind="stable")
    sorted_ids = every[order]
    cuts = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
    g_embed = (sorted_ids[cuts].astype(np.int64), np.add.reduceat(np.take(g_x, order, axis=0), cuts, axis=0))
    return loss, {
        "embed": g_embed, "query": g_project[:, :WIDTH] / scale, "key": g_project[:, WIDTH : 2 * WIDTH], "value": g_project[:, 2 * WIDTH :],
        "out": g_out, "lag": np.bincount(_LAG.ravel(), g_s.sum(axis=0).ravel(), 2 * BLOCK).astype(np.float32),
    }


def class_gradients(out: np.ndarray, bigram: np.ndarray, mixed: np.ndarray, ids: np.ndarray, wanted: np.ndarray, valid: np.ndarray, room: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient of ``out``, and that of ``mixed`` in two factors: rows and a number for each. Rows of classes are made
    ROWS at a time, so that they stay in the cache, and stay unscaled: what is scaled is as wide as ``mixed``."""
    n, kind = out.shape[1], mixed.dtype
    share = (valid / max(int(valid.sum()), 1)).astype(np.float32)
    g_out, g_mixed, total, logit, pace = np.zeros(out.shape, kind), np.empty_like(mixed), *np.empty((3, len(mixed)), kind)
    shifted = not norm(mixed, 1) * norm(out, 0) < room
    after, made, row, ones = np.empty((ROWS, n), bigram.dtype), np.empty((ROWS, n), kind), np.arange(ROWS) * n, np.ones(n, kind)
    for at in range(0, len(mixed), ROWS):
        some = slice(at, at + ROWS)
        m = mixed[some]
        p = np.matmul(m, out, out=made[: len(m)])
        p += np.take(bigram, ids[some], axis=0, out=after[: len(m)], mode="clip")
        if shifted:
            p -= p.max(axis=1, keepdims=True)
        cells, place = p.reshape(-1), row[: len(m)] + wanted[some]
        logit[some] = cells[place]
        np.exp(p, out=p)
        total[some] = sums = p @ ones
        cells[place] -= sums
        pace[some] = scaled = share[some] / sums
        np.matmul(p, out.T, out=g_mixed[some])
        g_out += (m * scaled[:, None]).T @ p
    return float(((np.log(total) - logit) * share).sum(dtype=np.float64)), g_out, g_mixed, pace


def fit(w: dict, bigram: np.ndarray, classes: np.ndarray, windows: tuple, batch: int = 256, rate: float = 4e-3, seed: int = 0) -> dict:
    """One pass of Adam over windows (ids, targets, first, valid), in a seeded order; returns new weights. Of
    ``embed`` a step moves the rows of the ids it saw, which costs as much as the windows do, not the vocabulary."""
    ids, targets, first, valid = windows
    room = plain_room(bigram)
    w = {name: x.copy() for name, x in w.items()}
    m = {name: np.zeros_like(x) for name, x in w.items()}
    s = {name: np.zeros_like(x) for name, x in w.items()}
    order = np.random.default_rng(seed).permutation(len(ids))
    steps = max(1, -(-len(order) // batch))
    for step in range(1, steps + 1):
        at = order[(step - 1) * batch : step * batch]
        _, g = gradients(w, bigram, classes, ids[at], targets[at], first[at], valid[at], room)
        pace = rate * min(1.0, 0.1 + 1.5 * (1 - step / (steps + 1)))
        for name, x in g.items():
            at, x = x if name == "embed" else (slice(None), x)
            first_moment = m[name][at] * np.float32(0.9) + x * np.float32(0.1)
            second_moment = s[name][at] * np.float32(0.99) + x * x * np.float32(0.01)
            m[name][at], s[name][at] = first_moment, second_moment
            w[name][at] -= np.float32(pace) * (first_moment / np.float32(1 - 0.9**step)) / (np.sqrt(second_moment / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return w


def cluster(counts: np.ndarray, groups: np.ndarray, per_group: int, rounds: int = 12) -> np.ndarray:
    """Classes of ids by the kinds of ids they follow: spherical k-means on counts (ids, kinds of the id
    before), apart within each group of ids. Ids without counts go to the first class of their group."""
    total = counts.sum(axis=1)
    lift = np.log1p(counts) - np.log1p(counts.sum(axis=0)[None, :] * total[:, None] / max(total.sum(), 1))
    lift /= np.linalg.norm(lift, axis=1, keepdims=True) + 1e-9
    classes = np.zeros(len(counts), np.int64)
    for g in range(int(groups.max()) + 1):
        classes[groups == g] = g * per_group
        used = np.flatnonzero((groups == g) & (total > 0))
        if not len(used):
            continue
        x, weight = lift[used], np.sqrt(total[used])[:, None]
        centres = lift[used[np.argsort(-total[used], kind="stable")[:per_group]]].copy()
        for _ in range(rounds):
            near = (x @ centres.T).argmax(axis=1)
            centres = np.zeros_like(centres)
            np.add.at(centres, near, x * weight)
            centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
        classes[used] = g * per_group + near
    return classes
