from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import pixels
from scoreloom.operators import scoring
from scoreloom.sources import files
from scoreloom.sources.models import LinearModel, Preprocess


def ppm(picture):
    return pixels.encode_image(picture, "note (1.0%)", "netpbm")


def random_picture(seed, height=9, width=7):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def jvm_image(spark, path, picture, form):
    """Write a real PNG or JPEG with the JVM's own encoder."""
    jvm = spark._jvm
    height, width, _ = picture.shape
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for y in range(height):
        for x in range(width):
            r, g, b = (int(v) for v in picture[y, x])
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    assert jvm.javax.imageio.ImageIO.write(image, form, jvm.java.io.File(str(path)))


def test_netpbm_round_trip():
    picture = random_picture(1)
    assert (pixels.decode_image(ppm(picture)) == picture).all()
    grey = b"P5\n# c\n3 2\n255\n" + bytes(range(6))
    back = pixels.decode_image(grey)
    assert back.shape == (2, 3, 3)
    assert (back[:, :, 0] == back[:, :, 2]).all() and back[1, 2, 1] == 5


@pytest.mark.parametrize("body", [b"", b"not an image", b"P5\n3 2\n255\n123", b"P6\n1 1\n65535\nabcdef"])
def test_undecodable(body):
    with pytest.raises(pixels.DecodeError):
        pixels.decode_image(body)


def test_spark_images_are_turned_to_rgb(spark, tmp_path):
    picture = random_picture(2)
    jvm_image(spark, tmp_path / "a b+c.png", picture, "png")
    rows = files.spark_images(spark, str(tmp_path)).collect()
    assert [r.path for r in rows] == [f"{tmp_path}/a b+c.png"]
    r = rows[0]
    assert (pixels.bgr_rows_to_rgb(bytes(r.data), r.height, r.width, r.channels) == picture).all()
    binary = files.binary_scan(spark, str(tmp_path)).select("path")
    assert files.with_normal_path(binary).first().path == r.path


def test_bad_file_in_the_image_source(spark, tmp_path):
    jvm_image(spark, tmp_path / "good.jpg", random_picture(3), "jpg")
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    kept = {r.path.rsplit("/", 1)[1]: r for r in files.spark_images(spark, str(tmp_path), "PERMISSIVE").collect()}
    assert kept["bad.jpg"].data is None and "not an image" in kept["bad.jpg"].error
    assert kept["good.jpg"].error is None
    assert files.spark_images(spark, str(tmp_path), "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="not an image"):
        files.spark_images(spark, str(tmp_path)).collect()


def brute_resize(picture, height, width):
    def axis(values, size):
        n = len(values)
        scale, out = n / size, []
        for o in range(size):
            centre = (o + 0.5) * scale
            weights = [max(0.0, 1 - abs(i + 0.5 - centre) / max(scale, 1.0)) for i in range(n)]
            whole = [int(w / sum(weights) * 2**22 + 0.5) for w in weights]
            out.append((2**21 + sum(w * v for w, v in zip(whole, values))) >> 22)
        return out

    across = np.array([[axis(row[:, c].tolist(), width) for c in range(3)] for row in picture.astype(int)])
    across = across.transpose(0, 2, 1)
    return np.array([[axis(across[:, x, c].tolist(), height) for c in range(3)] for x in range(width)]).transpose(2, 0, 1)


@pytest.mark.parametrize("shape, size", [((9, 7), (4, 5)), ((8, 8), (4, 4)), ((5, 6), (11, 13)), ((3, 3), (3, 3)), ((1, 40), (7, 1)), ((48, 64), (22, 23))])
def test_resize(shape, size):
    picture = random_picture(4, *shape)
    assert (pixels.resize(picture, *size) == brute_resize(picture, *size)).all()


def test_flat_colours_survive_resizing():
    for value in (0, 1, 127, 254, 255):
        assert (pixels.resize(np.full((31, 57, 3), value, np.uint8), 22, 23) == value).all()


def test_tensor_is_scaled_and_normalised():
    picture = np.full((5, 5, 3), 51, np.uint8)
    tensor = pixels.to_tensor(picture, 2, (0.2, 0.1, 0.0), (1.0, 0.5, 0.25))
    assert tensor.shape == (3, 2, 2)
    assert np.allclose(tensor[:, 0, 0], [0.0, 0.2, 0.8])


def test_forms():
    assert pixels.settle_form("netpbm") == "netpbm"
    assert pixels.settle_form("auto") == ("netpbm" if pixels.Image is None else "jpeg")
    with pytest.raises(ValueError):
        pixels.settle_form("png")
    if pixels.Image is None:
        with pytest.raises(RuntimeError):
            pixels.encode_image(random_picture(0), "x", "jpeg")


def test_annotation_draws_a_box():
    picture = np.full((60, 300, 3), 200, np.uint8)
    boxed = pixels.annotate(picture, "golf ball (99.0%)")
    assert (boxed[3, 3] == 0).all() and (boxed[0, 0] == 200).all() and (boxed[59, 299] == 200).all()
    assert (picture == 200).all()


class FakeCanvas(np.ndarray):
    """What the drawing library is asked to do, for machines that do not have it."""

    calls: list = []

    def convert(self, mode):
        self.calls.append(("convert", mode))
        return self

    def save(self, out, form, quality):
        self.calls.append(("save", form, quality))
        out.write(b"jpeg bytes")


def test_with_a_drawing_library(monkeypatch):
    class Image:
        fromarray = staticmethod(lambda a: a.view(FakeCanvas))
        open = staticmethod(lambda f: np.frombuffer(f.read(), np.uint8).reshape(1, 2, 3).view(FakeCanvas))

    FakeCanvas.calls = []
    monkeypatch.setattr(pixels, "Image", Image)
    assert pixels.settle_form("auto") == "jpeg"
    picture = pixels.decode_image(b"abcdef")
    drawn = pixels.annotate(picture, "church (9.9%)")
    assert pixels.encode_image(drawn, "church (9.9%)", "jpeg") == b"jpeg bytes"
    assert FakeCanvas.calls == [("convert", "RGB"), ("save", "JPEG", 90)]


def model_for(size=2, classes=3):
    rng = np.random.default_rng(0)
    return LinearModel(
        rng.normal(size=(classes, 3 * size * size)), rng.normal(size=classes), {i: f"c{i}" for i in range(classes)},
        Preprocess(size),
    )


def test_modes_for_bad_content(spark):
    rows = [(0, bytearray(ppm(random_picture(0)))), (1, bytearray(b"junk")), (2, None), (3, bytearray(ppm(random_picture(3, 4, 4))))]
    df = spark.createDataFrame(rows, "i int, content binary").coalesce(1)
    model = model_for()
    kept = {r.i: r.p for r in df.select("i", scoring.classify_content("content", model, 2, "PERMISSIVE").alias("p")).collect()}
    assert kept[0].error is None and kept[0].label in ("c0", "c1", "c2") and 1 / 3 <= kept[0].score <= 1
    assert kept[1].label is None and kept[1].error and kept[2].error == "no content"
    with pytest.raises(Exception, match="unknown image format"):
        df.select(scoring.classify_content("content", model).alias("p")).collect()
    with pytest.raises(ValueError):
        scoring.classify_content("content", model, mode="IGNORE")


def test_batch_size_and_partitions_do_not_matter(spark):
    rows = [(i, bytearray(ppm(random_picture(i, 4 + i % 3, 5)))) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, content binary")
    results = set()
    for parts, batch in ((1, 1), (3, 7), (8, 64)):
        scored = df.repartition(parts).select("i", scoring.classify_content("content", model_for(), batch).alias("p"))
        results.add(tuple(sorted((r.i, r.label, round(r.score, 9)) for r in scored.select("i", "p.*").collect())))
    assert len(results) == 1


def test_decoded_columns(spark):
    picture = random_picture(9, 4, 6)
    df = spark.createDataFrame([(1, bytearray(ppm(picture)))], "i int, content binary")
    row = scoring.picture_bytes(df).first()
    assert (row.height, row.width) == (4, 6) and bytes(row.data) == picture.tobytes()
    flat = scoring.picture_tensors(df, Preprocess(2)).select(F.size("tensor").alias("n")).first().n
    assert flat == 12
