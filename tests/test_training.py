import numpy as np
from pyspark.sql import functions as F

from corpus_search.operators import training


def _separable(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[5.0, 0, 0, 0], [0, 5.0, 0, 0], [0, 0, 5.0, 0]])
    rows = [(i, (centers[i % 3] + rng.normal(scale=0.5, size=4)).tolist(), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_split_is_deterministic_and_batched(spark):
    df = _separable(spark)
    a = training.split_batches(df).select("vec_id", "split", "batch").collect()
    b = training.split_batches(df.repartition(7)).select("vec_id", "split", "batch").collect()
    assert sorted(a) == sorted(b)
    train = [r for r in a if r.split == "train"]
    assert 0.7 < len(train) / len(a) < 0.9
    assert {r.batch for r in train} == set(range(int(np.ceil(len(train) / 64))))
    assert all(r.batch is None for r in a if r.split == "test")


def test_nearest_centroid_learns_separable_set(spark):
    parts = training.split_batches(_separable(spark))
    pred = training.nearest_centroid(parts.filter("split = 'train'"), parts.filter("split = 'test'"))
    acc = training.accuracy(pred).collect()[0]
    assert acc.accuracy > 95.0 and acc.n_test == acc.n_correct


def test_train_classifier_loss_falls_and_checkpoints(spark, tmp):
    parts = training.split_batches(_separable(spark))
    _, epochs = training.train_classifier(
        parts.filter("split = 'train'"), parts.filter("split = 'test'"), n_classes=3, epochs=4, checkpoint_dir=f"{tmp}/ck"
    )
    rows = epochs.orderBy("epoch").collect()
    assert rows[-1].loss < rows[0].loss
    assert rows[-1].accuracy > 95.0
    assert [r.checkpoint is not None for r in rows] == [False, True, False, True]
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    model = MultilayerPerceptronClassificationModel.load(rows[-1].checkpoint)
    assert model.numFeatures == 4
    assert F is not None


def _plain_adam(rows, n_classes, epochs, rate=0.001):
    """The same steps in one process: rows of (x, y, batch)."""
    dims = len(rows[0][0])
    w = np.zeros((dims + 1, n_classes))
    m, v, t, losses = np.zeros_like(w), np.zeros_like(w), 0, []
    for _ in range(epochs):
        total = 0.0
        for b in sorted({r[2] for r in rows}):
            x = np.array([[*r[0], 1.0] for r in rows if r[2] == b])
            y = np.array([r[1] for r in rows if r[2] == b])
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            total -= np.log(p[np.arange(len(y)), y]).sum()
            p[np.arange(len(y)), y] -= 1
            g = x.T @ p / len(y)
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(total / len(rows))
    return w, losses


def test_adam_equals_a_plain_run_and_goes_on_from_a_checkpoint(spark, tmp):
    parts = training.split_batches(_separable(spark, 300)).where("split = 'train'")
    odd = spark.createDataFrame([(9000, None, 1, "train", 0), (9001, [1.0, 1.0, 1.0, 1.0], None, "train", 0)], "vec_id long, embedding array<double>, label int, split string, batch long")
    model, epochs = training.train_adam(parts.unionByName(odd), 3, epochs=4, rate=0.05, checkpoint_dir=f"{tmp}/ck")
    rows = [(r.embedding, r.label, r.batch) for r in parts.collect()]
    want, losses = _plain_adam(rows, 3, 4, 0.05)
    got = epochs.orderBy("epoch").collect()
    assert np.allclose([r.loss for r in got], losses, atol=1e-9) and losses[-1] < losses[0]
    assert np.allclose(np.vstack([model.weight, model.bias]), want, atol=1e-9)
    assert [r.checkpoint is not None for r in got] == [False, True, False, True]
    layer, seen = training.load_layer(spark, f"{tmp}/ck", 2, 0.05)
    again, rest = training.train_adam(parts, 3, epochs=4, rate=0.05, start=(2, layer, seen))
    assert np.allclose(again.weight, model.weight, atol=1e-9) and [r.epoch for r in rest.collect()] == [3, 4]
    # the rate is really used
    slow, _ = training.train_adam(parts, 3, epochs=1, rate=0.001)
    assert 0 < np.abs(slow.weight).max() < 0.01 < np.abs(model.weight).max()


def test_adam_learns_and_predicts(spark):
    parts = training.split_batches(_separable(spark))
    model, _ = training.train_adam(parts.where("split = 'train'"), 3, epochs=3, rate=0.05)
    test = parts.where("split = 'test'").unionByName(spark.createDataFrame([(1, None, None, "test", None)], parts.schema))
    got = training.predict(test, model)
    assert training.accuracy(got.where("embedding is not null")).first().accuracy > 95
    assert got.where("embedding is null and prediction is null").count() == 1
    none, rows = training.train_adam(parts.limit(0), 3)
    assert rows.count() == 0 and none.weight.size == 0


def test_images_to_features_to_classifier(spark, tmp):
    """Bright left halves against bright right halves, through files, filters, pooling and training."""
    from corpus_search.operators import images
    from corpus_search.sources import files

    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        pixels = rng.integers(0, 120, (9, 12, 3)).astype(np.uint8)
        half = i % 2
        pixels[:, 6 * half : 6 * half + 6] += 100
        rows.append((f"{i}.{half}.png", files.png_bytes(pixels)))
    files.materialise(files.write_files(spark.createDataFrame(rows, "rel string, png binary"), f"{tmp}/img", "rel", "png"))
    scanned = files.scan_images(spark, f"{tmp}/img")
    found = images.image_features(scanned, size=12, grid=2).join(images.image_labels(scanned), "origin")
    data = found.select(F.regexp_extract("name", r"^([0-9]+)", 1).cast("long").alias("vec_id"), F.col("features").alias("embedding"), "label")
    assert data.first().embedding.__len__() == 6 * 9 * 4 and data.count() == 120
    parts = training.split_batches(data)
    model, epochs = training.train_adam(parts.where("split = 'train'"), 2, epochs=6, rate=0.02)
    assert training.accuracy(training.predict(parts.where("split = 'test'"), model)).first().accuracy > 95
    # one image at a time gives the same
    one = images.pooled(np.stack([images.normalize_array(r.image.data, r.image.height, r.image.width, 3, 12, images.MEAN, images.STD) for r in scanned.orderBy("image.origin").limit(3).collect()]), images.filter_bank(), 2)
    three = [r.features for r in found.orderBy("origin").limit(3).collect()]
    assert np.allclose(one, three, atol=1e-5)


def test_filters_against_loops():
    from corpus_search.operators import images

    rng = np.random.default_rng(1)
    x, bank = rng.normal(size=(2, 3, 7, 7)).astype(np.float32), images.filter_bank()
    assert np.allclose(np.einsum("kij,lij->kl", bank, bank), np.eye(9), atol=1e-12)
    got = images.pooled(x, bank, 1).reshape(2, 3, 18)
    for n in range(2):
        for c in range(3):
            for k in range(9):
                a = np.array([[(x[n, c, i : i + 3, j : j + 3] * bank[k]).sum() for j in range(5)] for i in range(5)])
                assert abs(got[n, c, k] - np.maximum(a, 0).mean()) < 1e-5 and abs(got[n, c, 9 + k] - np.maximum(-a, 0).mean()) < 1e-5


def test_normalised_images_flush_in_small_parts(spark, tmp, monkeypatch):
    from corpus_search.operators import images
    from corpus_search.sources import files

    rng = np.random.default_rng(2)
    rows = [(f"{i}.0.png", files.png_bytes(rng.integers(0, 255, (5 + i, 4, 3)).astype(np.uint8))) for i in range(7)]
    files.materialise(files.write_files(spark.createDataFrame(rows, "rel string, png binary"), f"{tmp}/img", "rel", "png"))
    scanned = files.scan_images(spark, f"{tmp}/img")
    whole = sorted(map(tuple, images.image_normalize(scanned, size=6).collect()))
    monkeypatch.setattr(images, "FLUSH_BYTES", 900)
    assert sorted(map(tuple, images.image_normalize(scanned, size=6).collect())) == whole and len(whole) == 7
