"""An autoencoder trained by data-parallel gradients: each step adds up partial gradients of all rows.

Rows are standardised and held as packed blocks. In a step every task computes
loss and gradient of its blocks for the weights that the driver sends; the sums go
up a tree of tasks, so the driver receives one vector however many tasks there
are, and the driver takes the step (Adam). The sum does not depend on how rows are
dealt, but for rounding. A hashed tenth of the rows is held out and tells when to
stop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.models import scored_rows

#: Hidden layers, weight decay, the greatest number of steps, and how many may pass without a better held-out loss.
LAYERS, DECAY, STEPS, PATIENCE = (32, 8, 32), 1e-4, 300, 10
#: Adam's step size and its two memories, and by what part a loss must fall to count as better.
RATE, FIRST, SECOND, BETTER = 0.01, 0.9, 0.999, 1e-4
#: Rows of one block.
BLOCK = 4096


def shapes(widths: list[int]) -> list[tuple[int, ...]]:
    return [s for a, b in zip(widths[:-1], widths[1:], strict=True) for s in ((a, b), (b,))]


def split(flat: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """Weights and biases of each layer as views of one vector."""
    out, at = [], 0
    for s in shapes(widths):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def start(widths: list[int], seed: int) -> np.ndarray:
    """Glorot's uniform weights, zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in shapes(widths):
        parts.append(rng.uniform(-1, 1, s) * np.sqrt(6 / sum(s)) if len(s) == 2 else np.zeros(s))
    return np.concatenate([p.ravel() for p in parts])


def forward(x: np.ndarray, layers: list[np.ndarray]) -> list[np.ndarray]:
    """The input and the output of each layer; all but the last are rectified."""
    out = [x]
    for k in range(0, len(layers), 2):
        y = out[-1] @ layers[k] + layers[k + 1]
        out.append(np.maximum(y, 0) if k + 2 < len(layers) else y)
    return out


def sums(x: np.ndarray, flat: np.ndarray, widths: list[int], gradient: bool = True) -> np.ndarray:
    """Rows, summed squared errors, and their gradient."""
    layers = split(flat, widths)
    out = forward(x, layers)
    error = out[-1] - x
    head = [len(x), float((error**2).sum())]
    if not gradient:
        return np.array(head)
    grads: list = [None] * len(layers)
    back = 2 * error
    for k in range(len(layers) - 2, -1, -2):
        grads[k], grads[k + 1] = out[k // 2].T @ back, back.sum(axis=0)
        if k:
            back = (back @ layers[k].T) * (out[k // 2] > 0)
    return np.concatenate([head, *[g.ravel() for g in grads]])


class Autoencoder:
    """Anomaly scores by the error of rebuilding a row through a narrow layer, learnt from benign rows."""

    def __init__(self, names: list[str], layers: tuple[int, ...] = LAYERS, *, steps: int = STEPS, patience: int = PATIENCE, rate: float = RATE, decay: float = DECAY, seed: int = 42, held_out: int = 10):
        self.names, self.widths = names, [len(names), *layers, len(names)]
        self.steps, self.patience, self.rate, self.decay, self.seed, self.held_out = steps, patience, rate, decay, seed, held_out

    def fit(self, df: DataFrame) -> Autoencoder:
        """Learns from all rows; null features count as 0. No rows is an error."""
        columns = [F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"_{i}") for i, c in enumerate(self.names)]
        d = df.select(*columns)
        stats = d.agg(*[f(c).alias(f"{n}{c}") for c in d.columns for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
        if not stats["n"]:
            raise ValueError("no rows to learn from")
        self.mean = np.array([stats[f"m_{i}"] for i in range(len(self.names))])
        std = np.array([stats[f"s_{i}"] for i in range(len(self.names))])
        self.std = np.where(std > 0, std, 1.0)
        mean, scale, width = self.mean, self.std, len(self.names)
        held = F.pmod(F.xxhash64(F.lit(self.seed), *d.columns), F.lit(max(self.held_out, 1))) == 0 if self.held_out > 1 else F.lit(False)

        def pack(batches):
            for b in batches:
                x = (np.column_stack([b.column(f"_{i}").to_numpy() for i in range(width)]) - mean) / scale if b.num_rows else np.zeros((0, width))
                out = b.column("_held").to_numpy(zero_copy_only=False)
                for flag in (False, True):
                    some = x[out == flag]
                    for at in range(0, len(some), BLOCK):
                        yield pa.RecordBatch.from_arrays([pa.array([flag]), pa.array([some[at : at + BLOCK].tobytes()], pa.binary())], names=["held", "data"])

        blocks = d.withColumn("_held", held).mapInArrow(pack, "held boolean, data binary").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._learn(blocks.rdd.map(tuple))
        finally:
            blocks.unpersist()
        return self

    def _learn(self, blocks) -> None:
        sc, widths = blocks.context, self.widths
        self.weights = start(widths, self.seed)
        size = len(self.weights)
        decayed = np.concatenate([np.full(int(np.prod(s)), len(s) == 2, float) for s in shapes(widths)])
        m, v = np.zeros(size), np.zeros(size)
        best, kept, since, self.losses = np.inf, self.weights, 0, []
        for step in range(1, self.steps + 1):
            shared = sc.broadcast(self.weights)

            def add(total, row, shared=shared):
                held, data = row
                x = np.frombuffer(data).reshape(-1, widths[0])
                got = sums(x, shared.value, widths, gradient=not held)
                if held:
                    total[:2] += got
                else:
                    total[2:] += got
                return total

            both = blocks.treeAggregate(np.zeros(size + 4), add, lambda a, b: a + b)
            shared.destroy()
            n, loss, gradient = both[2], both[3], both[4:]
            self.losses.append(loss / max(n, 1) / widths[0])
            watched = both[1] / both[0] / widths[0] if both[0] else self.losses[-1]
            if watched < best * (1 - BETTER):
                best, kept, since = watched, self.weights.copy(), 0
            else:
                since += 1
                if since >= self.patience:
                    break
            g = gradient / max(n, 1) / widths[0] + self.decay * decayed * self.weights / max(n, 1)
            m, v = FIRST * m + (1 - FIRST) * g, SECOND * v + (1 - SECOND) * g * g
            self.weights = self.weights - self.rate * (m / (1 - FIRST**step)) / (np.sqrt(v / (1 - SECOND**step)) + 1e-8)
        self.weights = kept

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return ((forward(z, split(self.weights, self.widths))[-1] - z) ** 2).mean(axis=1)

    def transform(self, df: DataFrame, keep: tuple[str, ...], out: str = "error") -> DataFrame:
        """The columns in `keep` and the mean squared error of each row."""
        return scored_rows(df, self.names, keep, self.score, out)
