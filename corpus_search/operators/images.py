"""Image rows from Spark's ``image`` source.

* ``image_labels``    - label = second dot-separated part of the file name as INT (``x.<label>.<ext>``);
                        rows without a parsable label or undecodable images are dropped and
                        can be counted with ``label_status``.
* ``image_normalize`` - nearest-neighbour resize, BGR -> RGB, scale to [0, 1], per-channel
                        standardisation; one flat ``array<float>`` (C, H, W order) per image.
* ``image_features``  - a bank of filters over the normalised image, rectified and pooled on a grid: a
                        short vector for a classifier (``training.train_adam``).

Pixels stay numpy buffers; a task hands on images as soon as they fill ``FLUSH_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 224 x 224 input and the per-channel (R, G, B) mean and std.
SIZE = 224
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


def _basename(origin: F.Column) -> F.Column:
    return F.element_at(F.split(origin, "/"), -1)


def label_status(images: DataFrame) -> DataFrame:
    base = _basename(F.col("image.origin"))
    label = F.expr("try_cast(split_part(element_at(split(image.origin, '/'), -1), '.', 2) AS INT)")
    return images.select(
        F.col("image.origin").alias("origin"),
        base.alias("name"),
        label.alias("label"),
        F.when(F.col("image.height") < 0, "undecodable").when(label.isNull(), "no_label").otherwise("ok").alias("status"),
    )


def image_labels(images: DataFrame) -> DataFrame:
    return label_status(images).filter(F.col("status") == "ok").select("origin", "name", "label")


def _resize_nearest(img: np.ndarray, size: int) -> np.ndarray:
    h, w = img.shape[:2]
    ys = np.minimum((np.arange(size) * h / size).astype(np.int64), h - 1)
    xs = np.minimum((np.arange(size) * w / size).astype(np.int64), w - 1)
    return img[ys][:, xs]


def normalize_array(data: bytes, height: int, width: int, channels: int, size: int, mean: Sequence[float], std: Sequence[float]) -> np.ndarray:
    img = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        img = np.repeat(img, 3, axis=2)
    rgb = img[:, :, 2::-1] if channels >= 3 else img  # Spark stores BGR(A)
    x = _resize_nearest(rgb, size).astype(np.float32) / 255.0
    x = (x - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)
    return np.transpose(x, (2, 0, 1))


#: Bytes of pixels that a task holds before it hands them on.
FLUSH_BYTES = 16 << 20


def _decodable(images: DataFrame) -> DataFrame:
    image = F.col("image")
    columns = [image[c].alias(a) for c, a in (("origin", "origin"), ("height", "h"), ("width", "w"), ("nChannels", "c"), ("data", "data"))]
    return images.filter(F.col("image.height") > 0).select(*columns)


def _tensors(batches: Iterator[pa.RecordBatch], size: int, mean, std, most: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Origins and normalised images (n x 3 x size x size, n at most ``most``), row by row out of the batches."""
    names, held = [], np.empty((most, 3, size, size), np.float32)
    for batch in batches:
        for k in range(batch.num_rows):
            name, h, w, c, data = (batch.column(i)[k] for i in range(5))
            held[len(names)] = normalize_array(data.as_buffer(), h.as_py(), w.as_py(), c.as_py(), size, mean, std)
            names.append(name.as_py())
            if len(names) == most:
                yield names, held
                names, held = [], np.empty_like(held)  # what was yielded may still be read
    if names:
        yield names, held[: len(names)]


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


def image_normalize(images: DataFrame, size: int = SIZE, mean=MEAN, std=STD, keep_pixels: bool = True) -> DataFrame:
    """Adds ``pixels`` (flat CHW float array, if ``keep_pixels``) and per-channel means."""
    most = max(1, FLUSH_BYTES // (12 * size * size))

    def run(batches):
        for names, x in _tensors(batches, size, mean, std, most):
            channel = x.reshape(len(x), 3, -1).mean(axis=2).astype(np.float64)
            columns = [pa.array(names, pa.string()), *(pa.array(channel[:, k]) for k in range(3))]
            if keep_pixels:
                columns.append(_lists(x.reshape(len(x), -1)))
            yield pa.RecordBatch.from_arrays(columns, ["origin", "mean_r", "mean_g", "mean_b", *(["pixels"] if keep_pixels else [])])

    ddl = "origin string, mean_r double, mean_g double, mean_b double" + (", pixels array<float>" if keep_pixels else "")
    return _decodable(images).mapInArrow(run, ddl)


def filter_bank(width: int = 3) -> np.ndarray:
    """width^2 filters of width x width: products of cosines, the constant one first; unit norm each."""
    place = (np.arange(width) + 0.5) * np.pi / width
    waves = np.cos(np.arange(width)[:, None] * place)
    bank = np.einsum("iy,jx->ijyx", waves, waves).reshape(-1, width, width)
    return bank / np.sqrt((bank**2).sum((1, 2), keepdims=True))


def pooled(x: np.ndarray, bank: np.ndarray, grid: int) -> np.ndarray:
    """Of images (n x 3 x s x s): each filter's answers on each channel, positive and negative parts apart, as means over a grid of cells."""
    width = bank.shape[-1]
    views = np.lib.stride_tricks.sliding_window_view(x, (width, width), axis=(2, 3))
    answers = np.einsum("ncyxij,kij->nckyx", views, bank.astype(np.float32), optimize=True)
    both = np.concatenate([np.maximum(answers, 0), np.maximum(-answers, 0)], axis=2)
    cuts = np.linspace(0, both.shape[-1], grid + 1).astype(int)
    rows = np.stack([both[..., a : max(b, a + 1), :].mean(-2) for a, b in zip(cuts[:-1], cuts[1:])], -2)
    return np.stack([rows[..., a : max(b, a + 1)].mean(-1) for a, b in zip(cuts[:-1], cuts[1:])], -1).reshape(len(x), -1)


def image_features(images: DataFrame, size: int = 32, grid: int = 4, mean=MEAN, std=STD) -> DataFrame:
    """(origin, features): filtered and pooled images, ``6 * 9 * grid^2`` numbers each."""
    bank = filter_bank()
    # the filters' answers take most: 18 maps of a channel, and what the sum is made of
    most = max(1, FLUSH_BYTES // (4 * 3 * 40 * size * size))

    def run(batches):
        for names, x in _tensors(batches, size, mean, std, most):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), _lists(pooled(x, bank, grid).astype(np.float32))], ["origin", "features"])

    return _decodable(images).mapInArrow(run, "origin string, features array<float>")
