"""Classifier training and evaluation on vectors, distributed with Spark ML.

* ``split_batches``      - deterministic train/test split and shuffled batch numbers from md5
                           of the id (no global sort, no single-partition window).
* ``nearest_centroid``   - mean vector per label (partial aggregation), prediction = nearest
                           mean (broadcast means, bounded by the number of classes).
* ``accuracy``           - 100 * correct / total, with the per-row comparison.
* ``train_classifier``   - softmax layer (``MultilayerPerceptronClassifier``) trained epoch by
                           epoch through ``initialWeights``; mean cross-entropy per epoch;
                           model saved every ``checkpoint_every`` epochs under a shared folder.
* ``train_adam``         - the same layer by mini-batches with Adam: the batches of ``split_batches``,
                           stored by segments of consecutive ones; a job passes through a segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.functions.vectors import mean_vectors
from corpus_search.operators import ivf, knn
from corpus_search.session import scratch_path

# Batch 64, 10 epochs, checkpoint every 2 epochs, learning rate 0.001, 5 folds
# (one held out for validation).
BATCH = 64
EPOCHS = 10
CHECKPOINT_EVERY = 2
LEARNING_RATE = 0.001
FOLDS = 5


def _hash_int(c, start: int) -> F.Column:
    return F.conv(F.substring(F.md5(F.col(c).cast("string")), start, 8), 16, 10).cast("bigint")


def split_batches(df: DataFrame, id_col: str = "vec_id", folds: int = FOLDS, batch: int = BATCH) -> DataFrame:
    """Adds ``split`` ('test' for fold 0, else 'train') and ``batch`` (train rows only)."""
    tagged = df.withColumn("split", F.when(F.pmod(_hash_int(id_col, 1), F.lit(folds)) == 0, "test").otherwise("train"))
    n_train = tagged.filter(F.col("split") == "train").count()
    n_batches = max(1, math.ceil(n_train / batch))
    return tagged.withColumn(
        "batch",
        F.when(F.col("split") == "train", F.pmod(_hash_int(id_col, 9), F.lit(n_batches))).cast("bigint"),
    )


def nearest_centroid(train: DataFrame, test: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Predicted label of each test row = label of the nearest class mean (ties: smaller label)."""
    means = mean_vectors(train, label_col, vec_col).select(F.col(label_col).cast("bigint").alias("cell_id"), F.col("mean").alias("centroid"))
    return ivf.assign_cells(test, means, vec_col, out_col="prediction")


def accuracy(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    correct = (F.col(pred_col).cast("bigint") == F.col(label_col).cast("bigint")).cast("bigint")
    return pred.agg(
        F.count("*").cast("bigint").alias("n_test"),
        F.coalesce(F.sum(correct), F.lit(0)).cast("bigint").alias("n_correct"),
        F.round(F.avg(correct) * 100.0, 6).alias("accuracy"),
    )


def _features(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select(array_to_vector(F.col(vec_col)).alias("features"), F.col(label_col).cast("double").alias("label"))


def epoch_loss(model, data: DataFrame) -> float:
    """Mean cross-entropy of a fitted probabilistic classifier on ``data`` (features, label)."""
    from pyspark.ml.functions import vector_to_array

    p = F.element_at(vector_to_array(F.col("probability")), (F.col("label") + 1).cast("int"))
    row = model.transform(data).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("loss")).collect()[0]
    return float(row["loss"])


def train_classifier(
    train: DataFrame,
    test: DataFrame,
    n_classes: int,
    vec_col: str = "embedding",
    label_col: str = "label",
    epochs: int = EPOCHS,
    iters_per_epoch: int = 5,
    checkpoint_dir: str | None = None,
    checkpoint_every: int = CHECKPOINT_EVERY,
    seed: int = 42,
) -> tuple[object, DataFrame]:
    """Train epoch by epoch; returns (model, per-epoch DataFrame(epoch, loss, accuracy, checkpoint))."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    tr = _features(train, vec_col, label_col)
    te = _features(test, vec_col, label_col)
    dims = len(tr.select("features").first()["features"])
    weights = None
    model = None
    rows = []
    for epoch in range(1, epochs + 1):
        mlp = MultilayerPerceptronClassifier(
            layers=[dims, n_classes], maxIter=iters_per_epoch, blockSize=BATCH, seed=seed, stepSize=LEARNING_RATE
        )
        if weights is not None:
            mlp.setInitialWeights(weights)
        model = mlp.fit(tr)
        weights = model.weights
        loss = epoch_loss(model, tr)
        acc_row = model.transform(te).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).collect()[0]
        path = None
        if checkpoint_dir and epoch % checkpoint_every == 0:
            path = f"{checkpoint_dir}/epoch={epoch}"
            model.write().overwrite().save(path)
        rows.append((epoch, round(loss, 6), round(100.0 * float(acc_row["a"] or 0.0), 6), path))
    spark = train.sparkSession
    return model, spark.createDataFrame(rows, "epoch int, loss double, accuracy double, checkpoint string")


# ------------------------------------------------------------------------------ mini-batch Adam

#: Adam's other settings, and tasks that add up the tasks' gradients before the driver does.
BETAS, EPSILON = (0.9, 0.999), 1e-8
MERGERS = 8


@dataclass(frozen=True)
class Softmax:
    """Weights (inputs x classes) and bias of a softmax layer."""

    weight: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def moved(self, change: np.ndarray) -> "Softmax":
        """The layer after a flat change of weight and bias."""
        size = self.weight.size
        return Softmax(self.weight + change[:size].reshape(self.weight.shape), self.bias + change[size:])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """[rows, summed cross-entropy, summed gradients of weight and bias]: what tasks add up."""
        p = self.probabilities(x)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).sum()
        p[np.arange(len(y)), y] -= 1
        return np.concatenate([[len(y), loss], (x.T @ p).ravel(), p.sum(0)])


class Adam:
    """One optimiser's moments over a flat vector of parameters."""

    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.step, self.first, self.second = rate, 0, np.zeros(size), np.zeros(size)

    def update(self, gradient: np.ndarray) -> np.ndarray:
        """What the gradient changes the parameters by."""
        self.step += 1
        self.first += (1 - BETAS[0]) * (gradient - self.first)
        self.second += (1 - BETAS[1]) * (gradient**2 - self.second)
        return -self.rate * (self.first / (1 - BETAS[0] ** self.step)) / (np.sqrt(self.second / (1 - BETAS[1] ** self.step)) + EPSILON)


def _gradient_sums(rows: DataFrame, model: Softmax, dims: int) -> np.ndarray:
    """The gradient of all rows (x, y), added up by tasks and then by few of them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = model.gradient(knn.matrix_of(batch.column(0), dims), batch.column(1).to_numpy().astype(np.int64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                total = total + np.frombuffer(sums)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.select("x", "y").mapInArrow(of, "sums binary")
    parts = parts.repartition(MERGERS).mapInArrow(merge, "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in parts.collect()), np.zeros(2 + model.weight.size + model.bias.size))


#: Rows of consecutive batches that one job passes through, and of a batch whose gradient many tasks add up.
SEGMENT_ROWS = 1 << 15


def _segments(sizes: list[tuple[int, int]], rows: int) -> list[list[int]]:
    """Batches (number, rows) in order, cut into runs of about ``rows`` rows; a batch of more is a run of its own."""
    out: list[list[int]] = []
    held = 0
    for number, n in sizes:
        if not out or held + n > rows:
            out.append([])
            held = 0
        out[-1].append(number)
        held += n
    return out


def _pass_through(rows: DataFrame, model: Softmax, adam: Adam, classes: int) -> tuple[Softmax, Adam, float, float]:
    """The steps of one segment's batches (x, y, batch), one after the other in one task that gets the layer and the
    moments and hands them back: a step needs the weights of the one before, and its gradient is of few rows."""
    dims = model.weight.shape[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer, seen = model, Adam(adam.first.size, adam.rate)
        seen.step, seen.first, seen.second = adam.step, adam.first.copy(), adam.second.copy()
        count, loss, now, part = 0.0, 0.0, None, None

        def step() -> None:
            nonlocal layer, count, loss
            count, loss = count + part[0], loss + part[1]
            layer = layer.moved(seen.update(part[2:] / part[0]))

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, number = knn.matrix_of(batch.column(0), dims), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if number[lo] != now and now is not None:
                    step()
                got = layer.gradient(x[lo:hi], y[lo:hi])
                part = part + got if number[lo] == now else got
                now = number[lo]
        if now is not None:
            step()
            numbers = np.concatenate([[count, loss, seen.step], layer.weight.ravel(), layer.bias, seen.first, seen.second])
            yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary())], ["state"])

    back = rows.select("x", "y", "batch").coalesce(1).sortWithinPartitions("batch").mapInArrow(of, "state binary").collect()
    a = np.frombuffer(back[0]["state"])
    size = dims * classes
    layer = Softmax(a[3 : 3 + size].reshape(dims, classes), a[3 + size : 3 + size + classes])
    after = Adam(size + classes, adam.rate)
    after.step, after.first, after.second = int(a[2]), a[3 + size + classes : 3 + 2 * (size + classes)], a[3 + 2 * (size + classes) :]
    return layer, after, float(a[0]), float(a[1])


def save_layer(spark: SparkSession, model: Softmax, path: str, epoch: int, seen: Adam | None = None) -> None:
    """A checkpoint: the weights, and the optimiser's moments, as a row for each in Parquet."""
    rows = [("weight", model.weight.ravel().tolist()), ("bias", model.bias.tolist())]
    if seen is not None:
        rows += [("first", seen.first.tolist()), ("second", seen.second.tolist()), ("step", [float(seen.step)])]
    spark.createDataFrame(rows, "name string, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def load_layer(spark: SparkSession, path: str, epoch: int, rate: float = LEARNING_RATE) -> tuple[Softmax, Adam]:
    got = {r["name"]: np.array(r["numbers"]) for r in spark.read.parquet(f"{path}/epoch={epoch}").collect()}
    seen = Adam(got["weight"].size + got["bias"].size, rate)
    if "step" in got:
        seen.first, seen.second, seen.step = got["first"], got["second"], int(got["step"][0])
    return Softmax(got["weight"].reshape(-1, got["bias"].size), got["bias"]), seen


def train_adam(
    train: DataFrame, n_classes: int, vec_col: str = "embedding", label_col: str = "label", epochs: int = EPOCHS, rate: float = LEARNING_RATE,
    checkpoint_dir: str | None = None, checkpoint_every: int = CHECKPOINT_EVERY, start: tuple[int, Softmax, Adam] | None = None,
) -> tuple[Softmax, DataFrame]:
    """Train on rows with ``batch`` numbers; returns (layer, per-epoch DataFrame(epoch, loss, checkpoint)).

    The rows are stored once by segments of consecutive batches. A job passes through a segment: its task gets the
    layer and the moments, makes the batches' steps in turn and hands them back, so an epoch is as many jobs as
    segments of ``SEGMENT_ROWS`` rows and the driver holds the layer and a number for each batch. A batch of more
    rows than a segment's (equal ids) has its gradient added up by many tasks. ``loss`` is the mean
    cross-entropy of an epoch's rows, each before its batch's step. ``start`` goes on from a checkpoint (its
    epoch, layer and moments). Rows without label, vector or batch are left out; no rows train nothing.
    """
    spark = train.sparkSession
    rows = train.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & F.col("batch").isNotNull())
    rows = rows.select(F.col(vec_col).alias("x"), F.col(label_col).cast("int").alias("y"), "batch")
    sizes = [(r["batch"], r["n"]) for r in rows.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]  # one number a step
    if not sizes:
        return Softmax(np.zeros((0, n_classes)), np.zeros(n_classes)), spark.createDataFrame([], "epoch int, loss double, checkpoint string")
    many = dict(sizes)
    runs = _segments(sizes, SEGMENT_ROWS)
    of_batch = spark.createDataFrame([(b, i) for i, run in enumerate(runs) for b in run], "batch long, segment int")
    path = scratch_path(spark, "batches")
    rows.join(F.broadcast(of_batch), "batch").repartition("segment").sortWithinPartitions("segment", "batch").write.partitionBy("segment").parquet(path)
    stored = [spark.read.schema(rows.schema).parquet(f"{path}/segment={i}") for i in range(len(runs))]
    _, dims = knn.count_and_width(rows, "x")
    done, model, adam = start or (0, Softmax(np.zeros((dims, n_classes)), np.zeros(n_classes)), Adam((dims + 1) * n_classes, rate))
    out = []
    for epoch in range(done + 1, epochs + 1):
        count = loss = 0.0
        for run, segment in zip(runs, stored):
            if many[run[0]] > SEGMENT_ROWS:
                sums = _gradient_sums(segment, model, dims)
                n, lost, model = sums[0], sums[1], model.moved(adam.update(sums[2:] / sums[0]))
            else:
                model, adam, n, lost = _pass_through(segment, model, adam, n_classes)
            count, loss = count + n, loss + lost
        saved = None
        if checkpoint_dir and epoch % checkpoint_every == 0:
            save_layer(spark, model, checkpoint_dir, epoch, adam)
            saved = f"{checkpoint_dir}/epoch={epoch}"
        out.append((epoch, float(loss / count), saved))
    return model, spark.createDataFrame(out, "epoch int, loss double, checkpoint string")


def predict(df: DataFrame, model: Softmax, vec_col: str = "embedding", out_col: str = "prediction") -> DataFrame:
    """``df`` with the likeliest class of each vector (the first of equal ones; null without a vector)."""
    from pyspark.sql.types import LongType, StructField, StructType

    dims, names = model.weight.shape[0], df.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.asarray(batch.column(names.index(vec_col)).is_valid())
            best = np.zeros(batch.num_rows, np.int64)
            if there.any():
                best[there] = model.probabilities(knn.matrix_of(batch.column(names.index(vec_col)).filter(pa.array(there)), dims)).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, mask=~there)], [*names, out_col])

    return df.mapInArrow(of, StructType([*df.schema.fields, StructField(out_col, LongType())]))
