"""Linear SVM with squared hinge loss, one plane per class against all others.

Each plane minimises ``|w|^2 / 2 + cost * sum(max(0, 1 - y * (w . x + b))^2)``, where ``w`` includes the
intercept ``b``. All planes are fitted together: a step sends the weights to the tasks, each task adds
the loss and the slope of its rows, and Spark sums them entry by entry, so the driver only ever holds
one number per feature and class. The steps follow a limited-memory quasi-Newton method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY = 10  # steps that the quasi-Newton method remembers
MAX_STEPS = 100


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of the entries of vectors, sparse or dense, in the order of the rows."""
    values = vectors.field("values")
    count = values.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    indices = vectors.field("indices")
    if not indices.null_count:
        return row, indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
    sparse = np.repeat(indices.is_valid().to_numpy(zero_copy_only=False), count)
    place[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, place, values.flatten().to_numpy(zero_copy_only=False)


def matrix(vectors: pa.StructArray, width: int) -> np.ndarray | None:
    """The vectors as rows of at most ``width`` columns if all are dense and of one length, else None."""
    values, indices = vectors.field("values"), vectors.field("indices")
    if not len(vectors) or values.null_count or indices.null_count < len(vectors):
        return None
    count = values.value_lengths().to_numpy()
    if (count != count[0]).any():
        return None
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(count), count[0])[:, :width]


def margins(vectors: pa.StructArray, planes: np.ndarray) -> tuple[np.ndarray, tuple | np.ndarray]:
    """``w . x + b`` of each row and plane; the last column of ``planes`` holds the intercepts.

    Also the entries of the vectors, or the matrix of them if all are dense: its products cost far less
    than sums entry by entry.
    """
    dense = matrix(vectors, planes.shape[1] - 1)
    if dense is not None:
        return dense @ planes[:, : dense.shape[1]].T + planes[:, -1], dense
    row, place, value = found = entries(vectors)
    if len(place) and place.max() >= planes.shape[1] - 1:  # features that no fitted row had weigh nothing
        known = place < planes.shape[1] - 1
        row, place, value = found = row[known], place[known], value[known]
    out = np.empty((len(vectors), len(planes)))
    for k, plane in enumerate(planes):
        out[:, k] = np.bincount(row, value * plane[place], len(vectors)) + plane[-1]
    return out, found


def loss_and_slope(rows: DataFrame, planes: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each plane and its slope, over rows ``(label int, x)`` with unwrapped vectors."""
    shape, width = planes.shape, planes.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slope, loss = shared.value, np.zeros(shape), np.zeros(shape[0])
        for batch in batches:
            side = np.where(batch.column(0).to_numpy()[:, None] == np.arange(shape[0]), 1.0, -1.0)
            scores, found = margins(batch.column(1), own)
            miss = np.maximum(0.0, 1.0 - side * scores)
            loss += cost * (miss * miss).sum(axis=0)
            pull = -2.0 * cost * side * miss
            if isinstance(found, np.ndarray):
                slope[:, : found.shape[1]] += pull.T @ found
            else:
                row, place, value = found
                for k in range(shape[0]):
                    slope[k] += np.bincount(place, value * pull[:, k][row], width)
            slope[:, -1] += pull.sum(axis=0)
        flat = np.append(slope.ravel(), loss)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["at", "part"])

    parts = rows.mapInArrow(run, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("part"))
    got = parts.toArrow()  # one row per feature and class
    shared.destroy()
    total = np.zeros(planes.size + shape[0])
    total[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return total[planes.size :] + 0.5 * (planes * planes).sum(axis=1), total[: planes.size].reshape(shape) + planes


def _ratio(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Row by row ``over / under``, 0 where nothing can be divided."""
    out = np.zeros_like(under)
    np.divide(over, under, out=out, where=under > 0)
    return out


def minimise(
    of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, tol: float, max_steps: int = MAX_STEPS
) -> np.ndarray:
    """The least points of convex functions, one per row of ``start``.

    ``of`` gives the values and slopes of all of them at once; they share the passes, but each has steps
    of its own. A function is done when its slope is no longer than ``tol``: with a penalty of
    ``|w|^2 / 2`` its weights are then no further than ``tol`` from the optimum.
    """
    dot = lambda x, y: (x * y).sum(axis=1, keepdims=True)
    at, (value, slope) = start, of(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_steps):
        still = np.linalg.norm(slope, axis=1) > tol
        if not still.any():
            break
        way, back = slope.copy(), []
        for move, change in reversed(moves):
            back.append(_ratio(dot(move, way), dot(move, change)))
            way -= back[-1] * change
        first = 1 / np.maximum(1.0, np.linalg.norm(slope, axis=1, keepdims=True))
        scale = _ratio(dot(*moves[-1]), dot(moves[-1][1], moves[-1][1])) if moves else first
        way *= np.where(scale > 0, scale, first)
        for (move, change), share in zip(moves, reversed(back), strict=True):
            way += move * (share - _ratio(dot(change, way), dot(move, change)))
        way[~still] = 0
        fall, step = dot(slope, way)[:, 0], np.ones(len(at))
        while True:
            there = at - step[:, None] * way
            new_value, new_slope = of(there)
            # A fall below the value's own rounding counts as one.
            high = still & (new_value > value - 1e-4 * step * fall + 1e-13 * np.abs(value)) & (step > 1e-9)
            if not high.any():
                break
            # The least point of the parabola through both values and the slope, kept within bounds.
            guess = _ratio(fall * step * step, 2 * (new_value - value + fall * step))
            step = np.where(high, np.clip(guess, 0.1 * step, 0.5 * step), step)
        move, change = there - at, new_slope - slope
        bent = dot(move, change) > 1e-12 * dot(change, change)
        moves = [*moves, (move * bent, change * bent)][-MEMORY:]
        at, value, slope = there, new_value, new_slope
        if (step[still] <= 1e-9).all():
            break
    return at


class PlanesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Predicts the class whose plane gives the highest score; ties go to the first class."""

    planes = Param(Params._dummy(), "planes", "weights of each class, the intercept last")

    @keyword_only
    def __init__(self, *, planes: list[list[float]] | None = None, featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(planes=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def scores(self, df: DataFrame, out: str) -> DataFrame:
        """Add the scores of all classes as an array."""
        planes = np.array(self.getOrDefault(self.planes))
        shared = df.sparkSession.sparkContext.broadcast(planes)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(vectors: pa.Array) -> pa.Array:
            found, _ = margins(vectors, shared.value)
            bounds = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            return pa.ListArray.from_arrays(bounds, pa.array(found.ravel()))

        return df.withColumn(out, score(F.unwrap_udt(self.getFeaturesCol())))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.scores(dataset, "rawPrediction")
        best = F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1
        return scored.withColumn(self.getPredictionCol(), best.cast("double"))


def fit_planes(
    rows: DataFrame,
    n_classes: int,
    label: str = "label",
    features: str = "features",
    cost: float = 1.0,
    tol: float = 1e-4,
    max_steps: int = MAX_STEPS,
) -> PlanesModel:
    """Fit one plane per class; labels are class numbers from 0. Store the rows before, as every step reads them."""
    plain = rows.select(F.col(label).cast("int").alias("label"), F.unwrap_udt(features).alias("x"))
    size = F.coalesce("x.size", F.size("x.values"))
    width = plain.agg(F.max(size)).first()[0] or 0
    start = np.zeros((n_classes, width + 1))
    planes = minimise(lambda w: loss_and_slope(plain, w, cost), start, tol, max_steps)
    return PlanesModel(planes=planes.tolist(), featuresCol=features)

