"""A regularised softmax classifier over hashed features, fitted with numpy."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from zlib import crc32

import numpy as np

BITS = 18
#: A name: a run of two or more capitalised words.
NAMES = re.compile(r"[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+)+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]+|_+")
_NINES = str.maketrans("0123456789", "9" * 10)
#: Numbers of zeros alone, which stand where a number is missing.
_ZEROS = re.compile(r"(?<![\d.,])0+(?![\d.])")
#: Stands before the form of a text that is all in capitals.
_CAPITALS = "\x00"


@lru_cache(maxsize=200_000)
def _slot(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def slots_of(features: list[str]) -> np.ndarray:
    """The slots of features, which is all that a fit keeps of an item."""
    return np.fromiter(map(_slot, features), np.int32, len(features))


def form_of(text: str) -> str:
    """A text with names as one word, digits as 9 and bare zeros as a word, in lower case: all that its features depend on."""
    form = NAMES.sub("Nn", text)
    if form.strip() == "Nn":  # nothing but a name: its words are all there is
        form += " " + text
    if "0" in form:
        form = _ZEROS.sub("zero", form)
    form = form.translate(_NINES).lower().strip()
    return _CAPITALS + form if text.isupper() else form


def text_features(text: str) -> list[str]:
    """Words, pairs of words, signs with their character pairs, and the shape of a text."""
    return form_features(form_of(text))


def form_features(form: str) -> list[str]:
    """The features of all texts of a form."""
    words = _WORDS.findall(form)
    out = ["#bias"]
    out += words
    out += [f"{a} {b}" for a, b in zip(words, words[1:])]
    for w in words:
        if not w[0].isalnum():
            out += [f"~{w[i : i + 2]}" for i in range(len(w) - 1)]
    if words:
        out += [f"^{words[0]}", f"{words[-1]}$"]
    plain = [w for w in words if w[0].isalpha()]
    n = len(plain)
    out.append(f"#n{min(12, n) if n < 12 else 12 + min(4, n // 12)}")
    if n > 1 and len(set(plain)) <= max(1, n // 2):
        out.append("#repeats")
    if form.startswith(_CAPITALS):
        out.append("#upper")
    out.append("#end" + (form[-1:] if form[-1:] in ".!?…:" else "none"))
    return out


class Softmax:
    """Linear scores per class; weights of shape (2 ** BITS, classes)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def probabilities(self, features: list[str]) -> np.ndarray:
        """The probability of each class for one item."""
        return softmax(self.total(features), len(features))

    def total(self, features: list[str]) -> np.ndarray:
        """The summed weights of features."""
        return self.weights[[_slot(f) for f in features]].sum(axis=0)


def softmax(total: np.ndarray, count: int) -> np.ndarray:
    """Probabilities of the classes from the summed weights of so many features."""
    z = total / math.sqrt(count or 1)
    z = np.exp(z - z.max())
    return z / z.sum()


class Scorer:
    """A classifier that keeps what it summed per form, so that texts of one form are looked at once."""

    def __init__(self, classifier: Softmax, most: int = 200_000):
        self.classifier, self.most = classifier, most
        self.forms: dict[str, str] = {}
        self.sums: dict[str, tuple[np.ndarray, int]] = {}
        self.got: dict[tuple, tuple[float, ...]] = {}

    def probabilities(self, text: str, more: tuple[str, ...]) -> tuple[float, ...]:
        """The probability of each class for a text with further features."""
        form = self.forms.get(text)
        if form is None:
            form = form_of(text)
            if len(text) < 400:  # long texts seldom come again
                if len(self.forms) > self.most:
                    self.forms.clear()
                self.forms[text] = form
        k = (form, more)
        got = self.got.get(k)
        if got is None:
            if len(self.got) > self.most or len(self.sums) > self.most:
                self.got.clear()
                self.sums.clear()
            known = self.sums.get(form)
            if known is None:
                features = form_features(form)
                known = (self.classifier.total(features), len(features))
            p = softmax(known[0] + self.classifier.total(list(more)), known[1] + len(more)) if more else softmax(*known)
            got = tuple(map(float, p))
            if len(form) < 400:
                self.sums[form], self.got[k] = known, got
        return got


def fit(items: list, labels: list[int], classes: int, times: list[float] | None = None, passes: int = 10, batch: int = 512, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Softmax:
    """Fit by adaptive gradient steps with weight decay; classes count alike however rare they are.

    Items are lists of features, or slots_of them, at least one each; `times` weighs them.
    A pass takes at least about 60 steps, so that small samples are learned as well. The result
    depends on the items and the seed only. Without items, or with items of one class, the
    classifier returns that class's prior.
    """
    weights, seen = np.zeros((1 << BITS, classes), np.float32), np.full((1 << BITS, classes), 1e-3, np.float32)
    if not items:
        return Softmax(weights)
    y = np.array(labels)
    much = np.ones(len(y)) if times is None else np.array(times, np.float64) * len(y) / max(1e-9, float(np.sum(times)))
    share = np.bincount(y, weights=much, minlength=classes)
    cost = np.where(share > 0, len(y) / (np.maximum(share, 1e-3) * (share > 0).sum()), 0.0)
    cost = ((cost**0.75)[y] * much).astype(np.float32)
    sizes = np.array([len(x) for x in items])
    slots = np.concatenate([x if isinstance(x, np.ndarray) else slots_of(x) for x in items]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scale = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)
    order, batch = np.random.default_rng(seed), min(batch, max(16, len(items) // 60))
    for _ in range(passes):
        for part in np.array_split(order.permutation(len(items)), max(1, len(items) // batch)):
            n = sizes[part]
            first = np.cumsum(n) - n
            flat = slots[np.arange(int(n.sum())) + np.repeat(starts[part] - first, n)]
            s = scale[part]
            z = np.add.reduceat(weights[flat], first, axis=0) * s[:, None]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(part)), y[part]] -= 1
            z *= (cost[part] * s)[:, None]
            used, where = np.unique(flat, return_inverse=True)
            spread = np.repeat(z, n, axis=0)
            g = np.stack([np.bincount(where, weights=spread[:, c], minlength=len(used)) for c in range(classes)], axis=1).astype(np.float32)
            g = g / len(part) + decay * weights[used]
            seen[used] += g * g
            weights[used] -= rate * g / np.sqrt(seen[used])
    return Softmax(weights)
