"""A small causal self-attention model of subword ids, in numpy: scoring and training of batches of windows."""

from __future__ import annotations

import numpy as np

WINDOW, CONTEXT = 24, 6  # a window holds CONTEXT tokens seen before and WINDOW - CONTEXT to score
WIDTH, CLASSES = 16, 48
STRIDE = WINDOW - CONTEXT


class Vocabulary:
    """Subword ids in classes, and how often each occurs: P(token) = P(class | context) * P(token | class)."""

    def __init__(self, counts: np.ndarray, opens_word: np.ndarray):
        self.counts = counts
        smooth = counts + 0.5
        self.classes = np.empty(len(counts), np.int64)
        # words' first subwords and others apart; in each part, classes of about equal mass in order of frequency
        parts = [np.flatnonzero(opens_word), np.flatnonzero(~opens_word)]
        first = int(np.clip(round(CLASSES * smooth[parts[0]].sum() / smooth.sum()), 1, CLASSES - 1))
        for part, base, n in zip(parts, (0, first), (first, CLASSES - first), strict=True):
            order = part[np.lexsort((part, -smooth[part]))]
            mass = np.cumsum(smooth[order])
            self.classes[order] = base + np.minimum((mass - smooth[order]) / mass[-1] * n, n - 1).astype(np.int64)
        self.class_mass = np.bincount(self.classes, weights=smooth, minlength=CLASSES)
        self.in_class = (np.log(smooth) - np.log(self.class_mass[self.classes])).astype(np.float32)


def initial(vocabulary: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    size = len(vocabulary.counts) + 1  # the last id opens every text
    mass = np.maximum(vocabulary.class_mass, 1e-3)
    return {
        "embedding": (rng.standard_normal((size, WIDTH)) * 0.3).astype(np.float32),
        "query": draw(WIDTH, WIDTH), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH), "skip": draw(WIDTH, WIDTH),
        "distance": np.zeros(WINDOW, np.float32), "hidden": np.zeros(WIDTH, np.float32),
        "out": draw(WIDTH, CLASSES), "bias": np.log(mass / mass.sum()).astype(np.float32),
    }


def windows(ids: np.ndarray, opening: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and mask of the windows of a text: each token is scored once, with CONTEXT or more tokens before it."""
    n = -(-len(ids) // STRIDE)
    padded = np.full(CONTEXT + 1 + n * STRIDE, opening, np.int64)
    padded[CONTEXT + 1:CONTEXT + 1 + len(ids)] = ids
    at = np.arange(n)[:, None] * STRIDE + np.arange(WINDOW)
    mask = (np.arange(WINDOW) >= CONTEXT) & (at - CONTEXT < len(ids))
    return padded[at], np.where(mask, padded[at + 1], 0), mask


_LATER = np.triu(np.ones((WINDOW, WINDOW), bool), 1)[CONTEXT:]
_GAP = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0)[CONTEXT:]
_PLACE = np.where(_LATER, WINDOW, _GAP)  # a later key is behind the last distance
_JOINED = ("query", "key", "value", "skip")


def _sums(rows: np.ndarray) -> np.ndarray:
    """The sum of each row, as a product."""
    return rows @ np.ones(rows.shape[1], rows.dtype)


def _forward(p: dict[str, np.ndarray], inputs: np.ndarray):
    """Hidden values of the last STRIDE positions of each window, and what they are made of. No other position is scored or has a gradient of its own, so
    the first ones are keys and values only. What all windows do alike is one product of flat rows.

    Queries and keys are clipped to 4 and distances to 10, so that no exponential overflows and none need be shifted.
    """
    n, kind = len(inputs), p["embedding"].dtype
    x = p["embedding"].take(inputs.ravel(), axis=0)
    joined = np.concatenate([p[name] for name in _JOINED], axis=1)
    # queries and keys, clipped together, and the rest
    clipped, rest = ((x @ joined[:, at:at + 2 * WIDTH]).reshape(n, WINDOW, 2 * WIDTH) for at in (0, 2 * WIDTH))
    np.clip(clipped, -4, 4, out=clipped)
    q, k, v, skip = clipped[:, CONTEXT:, :WIDTH], clipped[:, :, WIDTH:], rest[:, :, :WIDTH], rest[:, CONTEXT:, WIDTH:]
    weights = q @ k.transpose(0, 2, 1)
    weights *= kind.type(WIDTH**-0.5)
    weights += np.append(np.clip(p["distance"], -10, 10), kind.type(-1e9)).take(_PLACE)
    np.exp(weights, out=weights)
    inverse = (1 / _sums(weights.reshape(-1, WINDOW))).reshape(n, STRIDE, 1)
    summed = weights @ v
    summed *= inverse
    hidden = summed + skip
    hidden += p["hidden"]
    np.tanh(hidden, out=hidden)
    return x, joined, clipped, q, k, v, weights, inverse, summed, hidden


def _logits(p: dict[str, np.ndarray], hidden: np.ndarray) -> np.ndarray:
    logits = hidden.reshape(-1, WIDTH) @ p["out"]
    logits += p["bias"]
    return logits


def log_probabilities(p: dict[str, np.ndarray], vocabulary: Vocabulary, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of the last STRIDE targets of each window."""
    targets = targets[:, CONTEXT:]
    logits = _logits(p, _forward(p, inputs)[-1])
    right = logits.ravel().take(np.arange(0, logits.size, CLASSES) + vocabulary.classes.take(targets.ravel()))
    right -= np.log(_sums(np.exp(logits, out=logits)))
    return right.reshape(targets.shape) + vocabulary.in_class.take(targets)


def bounded(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parameters whose logits stay in the range of float32's exponential: hidden values lie within 1."""
    return {**p, "out": np.clip(p["out"], -4, 4), "bias": np.clip(p["bias"], -20, 20)}


def gradients(p: dict[str, np.ndarray], vocabulary: Vocabulary, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray):
    """Mean loss and its gradients; that of the embedding as rows for ``inputs``. Only the last STRIDE positions of a window may be in ``mask``."""
    x, joined, clipped, q, k, v, weights, inverse, summed, hidden = _forward(p, inputs)
    n, kind = len(inputs), x.dtype
    rows = hidden.reshape(-1, WIDTH)
    logits = _logits(p, hidden)
    if np.abs(p["out"]).sum(axis=0).max() + np.abs(p["bias"]).max() > 80:  # hidden values lie within 1: below that no exponential overflows
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    total = _sums(logits)
    chosen = mask[:, CONTEXT:].ravel()
    weight = chosen * kind.type(1 / max(np.count_nonzero(chosen), 1))
    wanted = np.arange(0, logits.size, CLASSES) + vocabulary.classes.take(targets[:, CONTEXT:].ravel())
    flat = logits.ravel()
    loss = -(np.log(flat.take(wanted) / total + 1e-30) @ weight)
    # shares less the wanted class's one, by weight
    logits *= (weight / total)[:, None]
    flat[wanted] -= weight
    ones = np.ones(len(rows), kind)
    g = {"out": rows.T @ logits, "bias": ones @ logits}
    d_sum = logits @ p["out"].T
    d_sum *= 1 - rows * rows
    g["hidden"] = ones @ d_sum
    along = _sums(d_sum * summed.reshape(-1, WIDTH)).reshape(n, STRIDE, 1)
    d_sum = d_sum.reshape(n, STRIDE, WIDTH)
    weights *= inverse
    d_scores = d_sum @ v.transpose(0, 2, 1)
    d_scores -= along
    d_scores *= weights  # nothing where a key comes later
    by_place = ones[:n] @ d_scores.reshape(n, -1)
    g["distance"] = np.bincount(_GAP.ravel(), weights=by_place, minlength=WINDOW).astype(np.float32) * (np.abs(p["distance"]) < 10)
    d_scores *= kind.type(WIDTH**-0.5)
    d_made = np.empty((n, WINDOW, 4 * WIDTH), kind)
    d_made[:, :CONTEXT] = 0
    np.matmul(d_scores, k, out=d_made[:, CONTEXT:, :WIDTH])
    np.matmul(d_scores.transpose(0, 2, 1), q, out=d_made[:, :, WIDTH:2 * WIDTH])
    if max(clipped.max(), -clipped.min()) >= 4:
        d_made[:, :, :2 * WIDTH] *= np.abs(clipped) < 4
    np.matmul(weights.transpose(0, 2, 1), d_sum, out=d_made[:, :, 2 * WIDTH:3 * WIDTH])
    d_made[:, CONTEXT:, 3 * WIDTH:] = d_sum
    d_made = d_made.reshape(-1, 4 * WIDTH)
    d_joined = x.T @ d_made
    g |= {name: d_joined[:, i * WIDTH:(i + 1) * WIDTH] for i, name in enumerate(_JOINED)}
    return float(loss), g, (d_made @ joined.T).reshape(n, WINDOW, WIDTH)


class Trainer:
    """Adagrad from given parameters; what it changed, and how often each embedding row was used. All but the embedding lies in one vector,
    of which ``p`` has views."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary, rate: float = 0.3):
        self.vocabulary, self.rate = vocabulary, rate
        self.names = [name for name in p if name != "embedding"]
        self.dense = np.concatenate([p[name].ravel() for name in self.names])
        ends = np.cumsum([p[name].size for name in self.names])
        parts = np.split(self.dense, ends[:-1])
        self.p = {"embedding": p["embedding"].copy()} | {name: part.reshape(p[name].shape) for name, part in zip(self.names, parts, strict=True)}
        self.seen, self.seen_dense = np.full(p["embedding"].shape, 1e-4, np.float32), np.full(self.dense.shape, 1e-4, np.float32)
        self.used = np.zeros(len(p["embedding"]), np.int64)
        self.kind = np.uint16 if len(p["embedding"]) <= 1 << 16 else np.int64
        self.steps = 0

    def step(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> float:
        loss, g, d_x = gradients(self.p, self.vocabulary, inputs, targets, mask)
        d = np.concatenate([g[name].ravel() for name in self.names])
        self.seen_dense += d * d
        d *= self.rate
        d /= np.sqrt(self.seen_dense)
        self.dense -= d
        # rows of one id lie together and are summed there; ids of two bytes are sorted by digits
        ids = inputs.ravel().astype(self.kind)
        order = np.argsort(ids, kind="stable")
        ids = ids.take(order)
        edges = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        first = edges[:-1]
        rows = ids.take(first).astype(np.int64)
        d = np.add.reduceat(d_x.reshape(-1, WIDTH).take(order, axis=0), first, axis=0)
        seen = self.seen.take(rows, axis=0)
        seen += d * d
        self.seen[rows] = seen
        d *= self.rate
        d /= np.sqrt(seen, out=seen)
        self.p["embedding"][rows] -= d
        self.used[rows] += edges[1:] - first
        self.steps += 1
        return loss
