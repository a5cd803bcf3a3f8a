"""Naive Bayes support vectors: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

The model is fitted by dual coordinate descent (Hsieh et al. 2008) on a bounded sample, in one task of an executor, and
travels as one array of ``2 ** bits`` float32 weights, whatever the size of the corpus.

Featurizers turn a text into the sorted distinct ids of its n-grams (hashed to ``bits`` bits). Scores are the logistic of
the margin, with slope and intercept (Platt scaling) fitted on margins that cross-validation gave to rows outside each fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def distinct(ids: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct values of ids, in any order, in linear time; stamp is scratch space over the id range."""
    at = np.arange(len(ids), dtype=stamp.dtype)
    stamp[ids] = at
    return ids[stamp[ids] == at]


@dataclass(frozen=True)
class CharNgrams:
    """Distinct character n-grams of the lower-cased text, blanks marking both ends."""

    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 19

    def scratch(self):
        return np.zeros(1 << self.bits, np.int32)

    def __call__(self, text: str | None, scratch) -> np.ndarray:
        codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes[(codes == 10) | (codes == 9) | (codes == 13)] = 32
        found, h = [], codes
        shift = np.uint64(64 - self.bits)
        for n in range(1, max(self.orders) + 1):
            if n > 1:
                if len(codes) < n:
                    break
                h = h[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
            if n in self.orders:
                found.append(((h + np.uint64(n)) * _GOLD) >> shift)
        ids = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        return distinct(ids, scratch)


class _WordIds(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


@dataclass(frozen=True)
class WordNgrams:
    """Distinct word n-grams plus the shapes of words and lines (case, digits, symbols), which mark junk in any language."""

    orders: tuple[int, ...] = (1, 2)
    bits: int = 19

    def scratch(self):
        return np.zeros(1 << self.bits, np.int32), _WordIds()

    def __call__(self, text: str | None, scratch) -> np.ndarray:
        stamp, words = scratch
        text = text or ""
        base = np.fromiter(map(words.__getitem__, text.split()), np.uint64)
        found, h, shift = [], base, np.uint64(64 - self.bits)
        for n in range(1, max(self.orders) + 1):
            if n > 1:
                if len(base) < n:
                    break
                h = h[:-1] * np.uint64(1_000_003) + base[n - 1 :]
            if n in self.orders:
                found.append(((h + np.uint64(n)) * _GOLD) >> shift)
        found.append(shapes(text) >> shift)
        return distinct(np.concatenate(found).astype(np.int32), stamp)


def shapes(text: str) -> np.ndarray:
    """Hashed indicators of what kinds of characters a text has, its length, and how much of it repeats: each measure, cut
    at fixed steps, sets the indicator of every step it reaches."""
    n = max(len(text), 1)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    small, capital, digit = (codes >= 97) & (codes <= 122), (codes >= 65) & (codes <= 90), (codes >= 48) & (codes <= 57)
    blank = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 13)
    symbol = (codes < 128) & ~(small | capital | digit | blank)
    words, lines = text.split(), text.split("\n")
    share = [x.sum() / n for x in (capital, digit, blank, symbol, codes >= 128)]
    share += [len(set(words)) / max(len(words), 1), len(set(lines)) / max(len(lines), 1), len(words) / n * 4]
    kinds = [f"{k}>{i}" for k, x in enumerate(share) for i in range(1, 21) if x > i / 20]
    kinds += [f"length>{i}" for i in range(24) if n >> i]
    import xxhash

    return np.array([xxhash.xxh64_intdigest(k) for k in kinds], np.uint64)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0, least: int = 1) -> np.ndarray:
    """Of each feature: the log of its share of the rows of class 1 over its share of those of class 0. Both shares are drawn
    towards each other by alpha rows that have it, dealt to the classes by their sizes, so that a feature without evidence has
    ratio 0 however uneven the classes are; so has one that fewer than `least` rows have."""
    p, q = np.zeros(size), np.zeros(size)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    up = float(y.sum())
    down = len(y) - up
    a, b = alpha * up / len(y), alpha * down / len(y)
    ratio = np.log((p + a) / (up + a)) - np.log((q + b) / (down + b))
    ratio[p + q < least] = 0
    return ratio.astype(np.float32)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int = 7) -> np.ndarray:
    """Minimises |w|^2 / 2 + cost * sum(max(0, 1 - y w.x)) over rows x = scale on their ids plus a constant, each row divided
    by its own length so that long and short texts weigh the same. Returns w, with the constant last.

    What is held and moved is w times scale: a row's margin is then a sum over its ids, and its step adds squares of scale. So
    rows need no values of their own beside their ids, and ids whose scale is 0 stay at 0."""
    product, square, bias = np.zeros(len(scale), np.float64), scale.astype(np.float64) ** 2, 0.0
    length = np.array([max(np.sqrt(square[x].sum()), 1e-9) for x in rows])
    alpha, sign = np.zeros(len(rows)), np.where(y > 0, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            now = product[x]
            g = sign[i] * (now.sum() / length[i] + bias) - 1.0
            new = min(max(alpha[i] - g / 2.0, 0.0), cost)  # each row and its constant have length 1
            if step := new - alpha[i]:
                product[x] = now + step * sign[i] / length[i] * square[x]  # a row's ids are distinct
                bias += step * sign[i]
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3 * cost:
            break
    return np.append(np.divide(product, scale, out=np.zeros_like(product), where=scale != 0), bias)


@dataclass
class Model:
    """scale: log-count ratios; weights: of the scaled, length-normalised indicators; a, b: of the logistic."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def __post_init__(self):
        self.product = (self.scale * self.weights).astype(np.float32)
        self.square = (self.scale * self.scale).astype(np.float32)

    def margin(self, ids: np.ndarray) -> float:
        length = np.sqrt(self.square[ids].sum(dtype=np.float64)) if len(ids) else 0.0
        return float(self.product[ids].sum(dtype=np.float64) / max(length, 1e-9) + self.bias)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(ids) + self.b, -500, 500))))

    def pack(self) -> bytes:
        head = np.array([self.bias, self.a, self.b], np.float64).tobytes()
        return head + self.scale.astype(np.float32).tobytes() + self.weights.astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        bias, a, b = np.frombuffer(data[:24], np.float64)
        scale, weights = np.frombuffer(data[24:], np.float32).reshape(2, -1)
        return cls(scale, weights, float(bias), float(a), float(b))


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for the slope and intercept of the logistic, with Platt's smoothed targets."""
    up, down = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, np.log((up + 1) / (down + 1))
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        grad = x @ (p - target) + np.array([1e-3 * a, 0])
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-6)), float(b)


def _threshold(margins: np.ndarray, y: np.ndarray) -> float:
    """The margin above which F1 is greatest, halfway to the next."""
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    return float((margins[order[at]] + margins[order[min(at + 1, len(y) - 1)]]) / 2)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int, cost: float = 1.0, epochs: int = 12, folds: int = 3, alpha: float = 1.0, least: int = 1, best_at: float | None = None) -> Model:
    """With one class only (or no row), every score is near that class's share, smoothed. best_at: the score that the margin
    of the greatest F1 in cross-validation shall have, where both classes have 20 rows or more; else the logistic is left as
    fitted. alpha and least (see log_count_ratio) are lowered where the smaller class has few rows."""
    size, n, up = 1 << bits, len(rows), int(y.sum())
    few = min(up, n - up)
    alpha, least = min(alpha, max(1.0, few / 15)), min(least, max(1, few // 10))
    if n == 0 or up in (0, n):
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log((up + 1) / (n - up + 1))))

    def one(at: np.ndarray) -> Model:
        own, label = [rows[i] for i in at], y[at]
        scale = log_count_ratio(own, label, size, alpha, least)
        w = dual_descent(own, label, scale, cost, epochs)
        return Model(scale, w[:-1].astype(np.float32), float(w[-1]))

    order = np.random.default_rng(11).permutation(n)
    margins = np.zeros(n)
    parts = [p for p in np.array_split(order, min(folds, n)) if len(p)]
    for part in parts:
        rest = np.setdiff1d(order, part)
        if 0 < y[rest].sum() < len(rest):
            model = one(rest)
            margins[part] = [model.margin(rows[i]) for i in part]
    model = one(np.arange(n))
    model.a, model.b = _platt(margins, y)
    if best_at is not None and few >= 20:
        model.b = float(np.log(best_at / (1 - best_at)) - model.a * _threshold(margins, y))
    return model
