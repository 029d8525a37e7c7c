"""Models of a question's dense weight: linear, polynomial, and small networks, with their gradients in NumPy.

A model turns a row of inputs (a query vector, features, or both) into one number; its sigmoid is the weight, or the probability of the dense class.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np

MAX_MONOMIALS = 150_000


def monomial_count(n: int, degree: int) -> int:
    """Monomials of ``n`` variables of degree 1 to ``degree``."""
    return sum(math.comb(n + k - 1, k) for k in range(1, degree + 1)) if n > 0 else 0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GELU (by tanh) and its slope."""
    c = math.sqrt(2 / math.pi)
    t = np.tanh(c * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * c * (1 + 3 * 0.044715 * x * x)


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and deviation 1."""
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) if x.shape[1] > 1 else x


@dataclass
class Net:
    """Dense layers with GELU between them."""

    weights: list[np.ndarray]  # each with a last row for the offset

    @staticmethod
    def make(sizes: list[int], rng: np.random.Generator) -> Net:
        return Net([np.vstack([rng.normal(0, 1 / math.sqrt(max(1, a)), (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:], strict=False)])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        kept = []
        for k, w in enumerate(self.weights):
            before = x
            x = before @ w[:-1] + w[-1]
            slope = None
            if k < len(self.weights) - 1:
                x, slope = _gelu(x)
            kept.append((before, slope))
        return x, kept

    def backward(self, kept: list, d: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        grads = []
        for w, (before, slope) in zip(reversed(self.weights), reversed(kept), strict=True):
            d = d * slope if slope is not None else d
            grads.append(np.vstack([before.T @ d, d.sum(0, keepdims=True)]))
            d = d @ w[:-1].T
        return d, grads[::-1]


@dataclass
class Model:
    kind: str
    embedding: int  # leading inputs that are the query vector; the rest are features
    features: int
    nets: list[Net] = field(default_factory=list)
    degree: int = 1

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs of each first-level net."""
        if self.kind == "tower":
            return [_normed(x[:, : self.embedding]), x[:, self.embedding :]]
        if self.kind == "polynomial":
            terms = [t for k in range(1, self.degree + 1) for t in combinations_with_replacement(range(x.shape[1]), k)]
            return [np.stack([x[:, t].prod(1) for t in map(list, terms)], axis=1)]
        if self.kind == "embedding_mlp":
            return [x[:, : self.embedding]]
        return [_normed(x) if self.kind == "mlp" else x]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0][:, 0]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list, list]:
        parts = [n.forward(p) for n, p in zip(self.nets, self.split(x), strict=False)]
        if self.kind != "tower":
            return parts[0][0], [parts[0][1]], []
        head, kept = self.nets[2].forward(np.hstack([p[0] for p in parts]))
        return head, [p[1] for p in parts] + [kept], [p[0].shape[1] for p in parts]

    def gradient(self, x: np.ndarray, slope: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[float, list[np.ndarray]]:
        """Sum of losses and the sums of their gradients; ``slope`` gives the loss of each score and its derivative."""
        out, kept, widths = self._forward(x)
        loss, d = slope(out[:, 0])
        d = d[:, None]
        if self.kind != "tower":
            return float(loss.sum()), self.nets[0].backward(kept[0], d)[1]
        d, head = self.nets[2].backward(kept[2], d)
        grads = []
        for k, part in enumerate(np.split(d, [widths[0]], axis=1)):
            grads += self.nets[k].backward(kept[k], part)[1]
        return float(loss.sum()), grads + head

    @property
    def parameters(self) -> list[np.ndarray]:
        return [w for n in self.nets for w in n.weights]

    def dumps(self) -> str:
        shape = {"kind": self.kind, "embedding": self.embedding, "features": self.features, "degree": self.degree}
        return json.dumps(shape | {"nets": [[w.tolist() for w in n.weights] for n in self.nets]})

    @staticmethod
    def loads(text: str) -> Model:
        d = json.loads(text)
        return Model(d["kind"], d["embedding"], d["features"], [Net([np.array(w) for w in ws]) for ws in d["nets"]], d["degree"])


def _linear(e: int, f: int, rng: np.random.Generator, **_) -> Model:
    return Model("linear", e, f, [Net.make([e + f, 1], rng)])


def _polynomial(e: int, f: int, rng: np.random.Generator, degree: int = 2, max_monomials: int = MAX_MONOMIALS, **_) -> Model:
    n = monomial_count(e + f, degree)
    if n > max_monomials:
        raise ValueError(f"{n} monomials are more than {max_monomials}")
    return Model("polynomial", e, f, [Net.make([n, 1], rng)], degree)


def _mlp(e: int, f: int, rng: np.random.Generator, hidden: int = 32, **_) -> Model:
    return Model("mlp", e, f, [Net.make([e + f, hidden, hidden // 2, 1], rng)])


def _embedding_mlp(e: int, f: int, rng: np.random.Generator, hidden: int = 32, **_) -> Model:
    return Model("embedding_mlp", e, f, [Net.make([e, hidden, hidden, 1], rng)])


def _tower(e: int, f: int, rng: np.random.Generator, hidden: int = 16, **_) -> Model:
    return Model("tower", e, f, [Net.make([e, hidden, hidden], rng), Net.make([f, hidden, hidden], rng), Net.make([2 * hidden, hidden, 1], rng)])


ARCHITECTURES: dict[str, Callable[..., Model]] = {"linear": _linear, "polynomial": _polynomial, "mlp": _mlp, "embedding_mlp": _embedding_mlp, "tower": _tower}


def architecture(name: str) -> Callable[..., Model]:
    if name not in ARCHITECTURES:
        raise ValueError(f"unknown architecture: {name}; known: {', '.join(sorted(ARCHITECTURES))}")
    return ARCHITECTURES[name]


Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # weights and curves to losses and their slopes by weight


def _regret(w: np.ndarray, curves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a weight loses against the best of its curve, linear between bins, and the slope."""
    n = curves.shape[1]
    x = np.clip(w, 0, 1) * (n - 1)
    lo = np.clip(x.astype(int), 0, n - 2)
    row = np.arange(len(w))
    step = curves[row, lo + 1] - curves[row, lo]
    return curves.max(1) - (curves[row, lo] + (x - lo) * step), -step * (n - 1)


def regret_loss(**_) -> Loss:
    return _regret


def hinge_squared_loss(epsilon: float = 0.0, **_) -> Loss:
    def loss(w, curves):
        r, slope = _regret(w, curves)
        over = np.maximum(r - epsilon, 0)
        return over * over, 2 * over * slope

    return loss


def boundary_magnet_loss(regret_threshold: float = 0.05, magnet_alpha: float = 0.02, **_) -> Loss:
    """Where the regret is above the threshold, the square of the way to the nearer end (0 on a tie); and always a pull to it."""

    def loss(w, curves):
        far = _regret(w, curves)[0] > regret_threshold
        gap = w - (w > 1 - w)
        return far * gap * gap + magnet_alpha * np.minimum(w, 1 - w), 2 * far * gap + magnet_alpha * np.where(w <= 0.5, 1.0, -1.0)

    return loss


LOSSES: dict[str, Callable[..., Loss]] = {"regret": regret_loss, "hinge_squared_regret": hinge_squared_loss, "boundary_magnet": boundary_magnet_loss}


def resolve_loss(name: str | None, **options: float) -> tuple[Loss, str, bool]:
    """The loss, the name that took effect, and whether it stands in for an unknown one."""
    key = (name or "regret").strip().lower().replace("-", "_")
    known = key if key in LOSSES else "regret"
    return LOSSES[known](**options), known, known != key


def cross_entropy(p: np.ndarray, target: np.ndarray, class_weight: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Loss of the dense class' probability against 0 or 1, and its slope by the score (not the probability)."""
    w = np.where(target > 0.5, class_weight[1], class_weight[0])
    q = np.clip(p, 1e-12, 1 - 1e-12)
    return -w * (target * np.log(q) + (1 - target) * np.log(1 - q)), w * (p - target)
