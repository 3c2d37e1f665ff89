"""A neural net with rectified units, fitted by Adam with early stopping.

A step takes one pass: the tasks add up the gradients of their blocks, the driver holds the weights and moves them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.many_fits import Blocks, Member, Room, added, held

RATE, MEAN_DECAY, SQUARE_DECAY, TINY = 0.01, 0.9, 0.999, 1e-8  # of Adam
PENALTY = 1e-4  # on half the squared weights, over the rows
LEAST_GAIN = 1e-4  # of the held-out loss that counts as one
CURVE = "step int, loss double, held_out_loss double"


@dataclass
class Net:
    """Layers of ``(weights, offsets)``; the last has one unit, whose value is the log odds."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def drawn(cls, sizes: Sequence[int], seed: int) -> Net:
        """Weights and offsets drawn evenly within sqrt(6 / (inputs + outputs))."""
        chance = np.random.default_rng(seed)
        layers = []
        for a, b in zip(sizes, sizes[1:]):
            bound = np.sqrt(6 / (a + b))
            layers.append((chance.uniform(-bound, bound, (a, b)), chance.uniform(-bound, bound, b)))
        return cls(layers)

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for layer in self.layers for v in layer])

    def like(self, flat: np.ndarray) -> Net:
        """A net of this shape with other numbers."""
        out, at = [], 0
        for w, b in self.layers:
            out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return type(self)(out)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.layers[:-1]:
            x = np.maximum(x @ w + b, 0)
        w, b = self.layers[-1]
        return (x @ w + b)[:, 0]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, room: Room | None = None) -> tuple[float, np.ndarray]:
        """Sum over the rows of the logistic loss, and its gradient in the order of ``flat``. Arrays are the ``room``'s, if there is one."""
        room = room or Room()
        inputs = [x]
        for k, (w, b) in enumerate(self.layers[:-1]):
            z = room.product(f"layer {k}", inputs[-1], w)
            z += b
            inputs.append(np.maximum(z, 0, out=z))
        w, b = self.layers[-1]
        z = (inputs[-1] @ w + b)[:, 0]
        loss = float((np.logaddexp(0, z) - y * z).sum())
        back = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)[:, None]
        parts = []
        for k in range(len(inputs) - 1, -1, -1):
            parts += [back.sum(axis=0), (inputs[k].T @ back).ravel()]
            if k:
                back = room.product(f"back {k}", back, self.layers[k][0].T)
                back *= inputs[k] > 0
        return loss, np.concatenate(parts[::-1])

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Sum over the rows of the logistic loss alone."""
        z = self.log_odds(x)
        return float((np.logaddexp(0, z) - y * z).sum())

    @property
    def penalised(self) -> np.ndarray:
        """True where ``flat`` holds a weight."""
        return np.concatenate([np.full(v.size, v.ndim == 2) for layer in self.layers for v in layer])


def fit_net(
    blocks: Blocks,
    held_out: Member,
    hidden: Sequence[int] = (64, 32),
    steps: int = 300,
    patience: int = 10,
    rate: float = RATE,
    seed: int = 42,
) -> tuple[Net, list[tuple[int, float, float]]]:
    """The net and its ``(step, loss, held_out_loss)``.

    ``held_out`` tells the rows that only judge (one column). The loss is the mean over the other rows, with a penalty;
    the held-out loss has none. Fitting ends after ``patience`` steps in a row whose held-out loss wasn't below the best
    one by ``LEAST_GAIN``, or after ``steps``; the weights of the least held-out loss are kept. A step uses all rows, so
    a run depends on nothing but the seed. Without rows to learn from the net stays as drawn; without held-out rows it
    takes all steps.
    """
    with held(blocks) as kept:
        return _fitted(kept, held_out, hidden, steps, patience, rate, seed)


def _fitted(
    blocks: Blocks, held_out: Member, hidden: Sequence[int], steps: int, patience: int, rate: float, seed: int
) -> tuple[Net, list[tuple[int, float, float]]]:
    net = Net.drawn([blocks.width, *hidden, 1], seed)
    flat, penalised = net.flat, net.penalised
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    best, least, waited, curve = flat, np.inf, 0, []
    for step in range(steps + 1):
        now, room = net.like(flat), Room()  # a task has its own copy of both

        def part(x: np.ndarray, y: np.ndarray, marks: np.ndarray, now: Net = now, room: Room = room) -> np.ndarray:
            out = held_out(marks)[:, 0]
            loss, gradient = now.loss_and_gradient(x[~out], y[~out], room)
            judged = now.loss(x[out], y[out])
            return np.concatenate([gradient, [loss, (~out).sum(), judged, out.sum()]])[:, None]

        sums = added(blocks, part, (len(flat) + 4, 1))[:, 0]
        loss, n, judged, n_out = sums[-4:]
        if not n:
            break
        weights = np.where(penalised, flat, 0)
        judged = judged / n_out if n_out else np.nan
        curve.append((step, float(loss / n + PENALTY / 2 * (weights @ weights) / n), float(judged)))
        if n_out:
            waited = 0 if judged < least - LEAST_GAIN else waited + 1
            if judged < least:
                best, least = flat, judged
            if waited >= patience:
                break
        else:
            best = flat
        if step == steps:
            break
        gradient = (sums[:-4] + PENALTY * weights) / n
        mean = MEAN_DECAY * mean + (1 - MEAN_DECAY) * gradient
        square = SQUARE_DECAY * square + (1 - SQUARE_DECAY) * gradient**2
        fair_mean = mean / (1 - MEAN_DECAY ** (step + 1))
        fair_square = square / (1 - SQUARE_DECAY ** (step + 1))
        flat = flat - rate * fair_mean / (np.sqrt(fair_square) + TINY)
    return net.like(best), curve


def loss_curve(spark, curve: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(curve, CURVE)


def net_scores(df: DataFrame, net: Net, name: str, keep: Sequence[str], features: str = "features") -> DataFrame:
    """``(keep..., model, y, p)`` of every row."""
    rows = df.select(*keep, F.lit(name).alias("model"), F.col("y").cast("int").alias("y"), vector_to_array(F.col(features)).alias("_x"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_x").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                z = net.log_odds(batch["_x"].flatten().to_numpy().reshape(len(batch), -1))
                columns = [c for c in batch.schema.names if c != "_x"]
                p = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], p], names=[*columns, "p"])

    return rows.mapInArrow(run, f"{shape}, p double")
