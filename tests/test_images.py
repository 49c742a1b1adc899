import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import image_kernels as K
from pixelmill.operators import images as I
from pixelmill.schemas import FEATURE_NAMES, LABEL_SCHEMA
from pixelmill.sources.tables import read_labels_csv
from tests.pngs import write_png


@pytest.fixture(scope="module")
def image_store(tmp_path_factory):
    root = tmp_path_factory.mktemp("imgs")
    rng = np.random.default_rng(0)
    imgs = {
        ("No_DR", "flat"): np.full((40, 50, 3), 90, np.uint8),
        ("Mild", "gradient"): np.tile(np.linspace(0, 255, 64).astype(np.uint8)[None, :, None], (48, 1, 3)),
        ("Moderate", "checker"): (np.indices((64, 64)).sum(axis=0) // 8 % 2 * 255).astype(np.uint8)[:, :, None]
        .repeat(3, axis=2),
        ("Severe", "random"): rng.integers(0, 256, (70, 90, 3), dtype=np.uint8),
        ("No_DR", "orphan_image"): rng.integers(0, 256, (20, 20, 3), dtype=np.uint8),
    }
    for (folder, key), arr in imgs.items():
        os.makedirs(root / folder, exist_ok=True)
        write_png(str(root / folder / f"{key}.png"), arr)
    with open(root / "Severe" / "bad.png", "wb") as f:
        f.write(b"not a png at all")
    labels = root.parent / (root.name + "_labels.csv")
    labels.write_text("id_code,diagnosis\nflat,0\ngradient,1\nchecker,2\nrandom,3\nbad,3\norphan_label,4\n")
    return str(root), str(labels), imgs


def test_kernel_closed_forms():
    flat = K.image_features(np.full((30, 30, 3), 77, np.uint8))
    f = dict(zip(FEATURE_NAMES, flat))
    assert f["R_std"] == 0 and f["R_skew"] == 0 and f["entropy"] == 0
    assert f["edge_density"] == 0 and f["contrast"] == 0
    rng = np.random.default_rng(1)
    r = dict(zip(FEATURE_NAMES, K.image_features(rng.integers(0, 256, (64, 64, 3), dtype=np.uint8))))
    assert abs(sum(r[f"intensity_hist_{i}"] for i in range(10)) - 1) < 1e-12
    assert abs(r["edge_mean"] - 255 * r["edge_density"]) < 1e-9


def test_gray_hsv_known_values():
    px = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0]]], np.uint8)
    hsv = K.rgb_to_hsv(px)[0]
    assert hsv.tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0]]
    assert K.rgb_to_gray(px)[0].tolist() == [76, 150, 29, 255, 0]


def test_canny_step_edge():
    img = np.zeros((32, 32), np.uint8)
    img[:, 16:] = 255
    e = K.canny(img)
    cols = np.where(e.any(axis=0))[0]
    assert e.max() == 255 and set(cols) <= {15, 16}


def test_resize_identity_and_constant():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (256, 256, 3), dtype=np.uint8)
    assert (K.resize_bilinear(a) == a).all()
    c = np.full((7, 9, 3), 33, np.uint8)
    assert (K.resize_bilinear(c) == 33).all()


def test_image_source_join_and_extract(spark, image_store):
    root, labels_csv, imgs = image_store
    images = I.read_images(spark, root)
    assert images.count() == 5  # bad.png dropped by the source
    labels = read_labels_csv(spark, labels_csv, LABEL_SCHEMA)
    matched, missing = I.label_images(images, labels)
    assert sorted(r["id_code"] for r in matched.select("id_code").collect()) == ["checker", "flat", "gradient",
                                                                                "random"]
    assert sorted(r["id_code"] for r in missing.collect()) == ["bad", "orphan_label"]
    feats = {r["id_code"]: r for r in I.extract_features(matched, ["id_code", "diagnosis"]).collect()}
    for (folder, key), arr in imgs.items():
        if key not in feats:
            continue
        want = K.image_features(arr)
        got = [feats[key][n] for n in FEATURE_NAMES]
        assert np.allclose(got, want, atol=1e-9), key


def test_arrays_of_any_length_become_images(spark):
    rows = [(n, [0.25] * n) for n in (64, 60, 65, 1)] + [(0, []), (-1, None)]
    images = I.images_from_arrays(spark.createDataFrame(rows, "id long, a array<float>"), "a", 8, ["id"])
    assert {r["id"] for r in I.extract_features(images, ["id"]).collect()} == {64, 60, 65, 1}
    assert {r["id"] for r in I.invalid_images(images, ["id"]).collect()} == {0, -1}
    sizes = {r["id"]: (r["height"], r["n"]) for r in images.select("id", "image.height", F.length("image.data").alias("n")).collect()}
    assert [sizes[n] for n in (64, 60, 65, 1)] == [(8, 192), (8, 192), (9, 216), (1, 24)]


def test_extraction_runs_nothing_and_shuffles_nothing(spark, image_store):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.sparkContext.setJobGroup("define-features", "none expected")
    feats = I.extract_features(I.with_image_keys(I.read_images(spark, image_store[0])), ["id_code"])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("define-features")) == []
    assert "Exchange" not in feats._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("shape", [(300, 400), (257, 256), (1000, 120), (3, 2), (256, 300)])
def test_resize_is_one_double_formula(shape):
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (*shape, 3), dtype=np.uint8)
    got = K.resize_bilinear(img, 64, 48)
    for y, x in [(0, 0), (63, 47), *rng.integers(0, 48, (40, 2))]:
        def axis(o, src, dst):
            f = (o + 0.5) * (src / dst) - 0.5
            lo = int(np.floor(f))
            w = 0.0 if lo < 0 else f - lo
            lo = min(max(lo, 0), src - 1)
            return lo, min(lo + 1, src - 1), w
        y0, y1, wy = axis(y, shape[0], 64)
        x0, x1, wx = axis(x, shape[1], 48)
        rows = [img[y0, c].astype(float) * (1 - wy) + img[y1, c].astype(float) * wy for c in (x0, x1)]
        want = np.floor(rows[0] * (1 - wx) + rows[1] * wx + 0.5)
        assert (got[y, x] == want).all()


def test_images_from_arrays_roundtrip(spark):
    vals = [[(i - 32) / 64.0 for i in range(64)]]
    df = spark.createDataFrame([(1, v) for v in vals], "id long, a array<float>")
    row = I.images_from_arrays(df, "a", 8, ["id"]).collect()[0]["image"]
    img = K.decode(bytes(row["data"]), row["height"], row["width"], row["nChannels"])
    assert img.shape == (8, 8, 3)
    b = np.floor((np.array(vals[0]) + 0.5) * 256).clip(0, 255)
    assert (img[:, :, 2].ravel() == b).all()  # channel 0 (B) lands last after BGR -> RGB


def test_prepare_and_train_end_to_end(spark, image_store, tmp_path):
    """Entry points A and B on image files: features, split, balance, three
    grids, saved models, metric CSVs read back (S7/S8), comparison, insights."""
    from pixelmill.operators import compare as C
    from pixelmill.operators.models import load_models
    from pixelmill.plans import prepare as P
    from pixelmill.plans import train as Tr
    from pixelmill.schemas import MODEL_NAMES
    from pixelmill.sources.tables import read_metrics_csv

    root, labels_csv, _ = image_store
    prep = P.prepare_images(spark, root, labels_csv, str(tmp_path / "prep"), balance="none")
    assert prep.table.select("id_code").distinct().count() == 4
    assert sorted(r["id_code"] for r in prep.unmatched_labels.collect()) == ["bad", "orphan_label"]
    assert all(r[0].endswith(".png") and r[0].startswith("file:") for r in prep.table.select("image_path").collect())
    # four images are too few to train on: replicate them under new ids
    big = prep.table.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(29))))
    big = big.withColumn("id_code", F.concat_ws("-", "id_code", "rep")).drop("rep", "split", "fold", "copy")
    from pixelmill.operators import sampling as B
    from pixelmill.operators.models import fold_column
    big = B.hash_split(big, "id_code").withColumn("fold", fold_column("id_code"))
    out = str(tmp_path / "models")
    spark_df, twin_df, comp = Tr.report(big, out, P.feature_columns(), twin=False)
    assert spark_df.count() == 3 and twin_df is None
    back = read_metrics_csv(spark, out + "/spark_results")
    assert back.count() == 3
    assert read_metrics_csv(spark, out + "/missing").count() == 0
    assert {r["source"]: r["count"] for r in Tr.results_from_files(spark, out).groupBy("source").count().collect()} == {
        "spark": 3, "comparison": 3}
    assert Tr.results_from_files(spark, out + "/none").count() == 0
    assert spark.read.option("header", True).csv(out + "/cv_results").count() == 12
    assert spark.read.option("header", True).csv(out + "/confusion_matrices").count() >= 3
    models, cat = load_models(spark, out, MODEL_NAMES)
    assert cat.count() == 3
    scored = models["random_forest"].transform(prep.table)
    assert scored.count() == prep.table.count()
    assert C.insights(comp.withColumn("position", F.monotonically_increasing_id())).count() == 2


def test_stream_of_image_files_equals_batch(spark, image_store, tmp_path):
    """R3 over image files: new files are decoded, featurised and scored by a
    saved pipeline; the streamed result equals the batch result."""
    from pixelmill.operators.features import assembler
    from pixelmill.operators.models import classifier_pipeline
    from pixelmill.operators.scoring import score
    from pixelmill.streaming import scoring as St

    root, _, _ = image_store
    keyed = I.with_image_keys(I.read_images(spark, root))
    feats = I.extract_features(keyed, ["id_code"]).withColumn(
        "label", (F.col("id_code").isin("random", "checker")).cast("int"))
    base, _ = classifier_pipeline("lr")
    model = base.copy().setStages([assembler(list(FEATURE_NAMES), "features", "skip")] + base.getStages()).fit(feats)
    batch = {r["id_code"]: r["prediction"] for r in score(model, feats, ["id_code"], "lr").collect()}
    src = St.image_stream(spark, root, max_files_per_trigger=2)

    def prep(df):
        return I.extract_features(I.with_image_keys(df), ["id_code"])

    out = St.stream_score(spark, model, src, ["id_code"], "lr", prepare=prep)
    assert {r["id_code"]: r["prediction"] for r in out.collect()} == batch


def test_labelled_features_and_file_listing(spark, image_store):
    root, labels_csv, imgs = image_store
    labels = read_labels_csv(spark, labels_csv, LABEL_SCHEMA)
    feats, missing = I.labelled_features(spark, root, labels)
    assert sorted(r["id_code"] for r in feats.select("id_code").collect()) == ["checker", "flat", "gradient",
                                                                              "random"]
    assert sorted(r["id_code"] for r in missing.collect()) == ["bad", "orphan_label"]  # bad.png: no features
    keys = {r["id_code"] for r in I.image_keys(spark, root).collect()}
    assert {"bad", "orphan_image", "flat"} <= keys


def test_images_of_no_labelled_folder_are_not_read(spark, image_store):
    root, _, _ = image_store
    labels = spark.createDataFrame([], "id_code string, diagnosis int")
    feats, missing = I.labelled_features(spark, root, labels)
    assert feats.count() == 0 and missing.count() == 0


def _grown(mask, seeds):
    """Seeds spread over a mask, one step at a time."""
    while True:
        p = np.pad(seeds, 1)
        near = np.logical_or.reduce([p[dy:dy + mask.shape[0], dx:dx + mask.shape[1]] for dy in range(3) for dx in range(3)])
        if ((near & mask) == seeds).all():
            return seeds
        seeds = near & mask


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (12, 17), (40, 40)])
def test_components_equal_growing(shape):
    rng = np.random.default_rng(shape[0])
    for share in (0.0, 0.2, 0.45, 0.7, 1.0):
        mask = rng.uniform(size=shape) < share
        parts = K.components(mask)
        assert (parts[~mask] == mask.size).all()
        for y, x in np.argwhere(mask)[:40]:
            seed = np.zeros(shape, bool)
            seed[y, x] = True
            assert ((parts == parts[y, x]) == _grown(mask, seed)).all()


def test_a_long_spiral_is_one_component_in_little_time():
    import time
    n = 256
    mask = np.zeros((n, n), bool)
    top, left, bottom, right = 0, 0, n - 1, n - 1
    while top <= bottom and left <= right:
        mask[top, max(0, left - 2):right + 1] = True
        mask[top:bottom + 1, right] = True
        mask[bottom, left:right + 1] = True
        mask[top + 2:bottom + 1, left] = True
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    t = time.perf_counter()
    parts = K.components(mask)
    assert time.perf_counter() - t < 2 and len(np.unique(parts[mask])) == 1 and mask.sum() > 20_000


def test_canny_equals_growing_from_strong_pixels():
    rng = np.random.default_rng(8)
    for size in (16, 64, 256):
        smooth = rng.uniform(0, 255, (size // 8, size // 8)).repeat(8, 0).repeat(8, 1)
        gray = np.clip(smooth + rng.normal(0, 12, (size, size)), 0, 255).astype(np.uint8)
        weak, strong = K.canny(gray, 60, 60) > 0, K.canny(gray, 180, 180) > 0
        assert (weak >= strong).all() and ((K.canny(gray, 60, 180) > 0) == _grown(weak, strong)).all()
