import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import jpeg

SF = "/root/testdata/sf0.001"


def hard_payloads():
    rng = random.Random(1)
    out = [jpeg.padded(t) for t in (None, "a", "`" * 700, "hello " * 100, "é" * 999, "a`````````````````````b" * 50, "x" * 63 + "`" * 64 + "y`b" * 400)]
    out += [bytes(rng.choice([96, 96, 96, 97, 95, 98, rng.randrange(256)]) for _ in range(64 * rng.randint(1, 90))) for _ in range(40)]
    return out + [bytes(range(256)) * 3, b"\xff" * 640, b"\0" * 64 * 7000]


def test_round_trip_of_hard_payloads(monkeypatch):
    for lanes in (3, 4096):
        monkeypatch.setattr(jpeg, "LANES", lanes)
        payloads = hard_payloads()[: None if lanes > 9 else 20]
        images, coefficients = jpeg.read(jpeg.encode(payloads))
        assert [jpeg.payload_of(i, coefficients) for i in images] == payloads


def test_files_are_alike_alone_and_together():
    payloads = hard_payloads()[:12]
    assert jpeg.encode(payloads) == [jpeg.encode([p])[0] for p in payloads]


def java_pixels(spark, data: bytes) -> np.ndarray:
    """What the Java library's reader makes of a file."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    w, h = image.getWidth(), image.getHeight()
    argb = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), dtype=np.int64).reshape(h, w)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=2)


def test_another_reader_sees_the_same_pictures(spark):
    """Chroma without AC is alike under any upsampling of flat macroblocks, so all pixels must agree; elsewhere luma must."""
    rng = np.random.default_rng(2)
    for n in (1, 6, 40):
        blocks = np.full((n * 6, 64), jpeg.ZERO, np.uint8)
        blocks[:, :20] = np.clip(jpeg.ZERO + rng.normal(size=(n * 6, 20)) * 12, 0, 255)
        blocks[4::6], blocks[5::6] = jpeg.ZERO, jpeg.ZERO
        blocks[4::6, 0], blocks[5::6, 0] = 130, 40
        (data,) = jpeg.encode([blocks.tobytes()])
        images, coefficients = jpeg.read([data])
        mine = jpeg.tensor(images[0], coefficients).astype(int)
        assert np.abs(java_pixels(spark, data) - mine).max() <= 2


def test_foreign_file(spark):
    """A progressive file by another writer: no restart markers, its own tables and end-of-band runs, odd size."""
    jvm = spark._jvm
    w, h = 53, 37
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:h, 0:w]
    smooth = np.stack([x * 4 % 256, y * 6 % 256, (x + y) * 2 % 256], axis=2) // 2 + rng.integers(0, 9, size=(h, w, 3))
    for i in range(h):
        for j in range(w):
            r, g, b = (int(v) for v in smooth[i, j])
            image.setRGB(j, i, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    data = bytes(out.toByteArray())
    images, coefficients = jpeg.read([data, data])
    assert any(s[0].high for s in images[0].scans) and len(images[0].scans) > 6
    mine = jpeg.tensor(images[1], coefficients).astype(int)
    assert mine.shape == (h, w, 3)
    gap = np.abs(java_pixels(spark, data) - mine)
    assert gap.mean() < 4 and np.percentile(gap, 90) <= 10  # readers differ in how they upsample chroma


def test_query_against_direct_computation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in jpeg.digest(jpeg.encode_column(docs)).collect()}
    for d in docs.collect():
        payload, r = jpeg.padded(d.text), rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes) == (len(d.text.encode()), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = {r.doc_id: r.media for r in jpeg.encode_column(docs.limit(20)).collect()}
    for doc, data in media.items():
        assert (rows[doc].media_bytes, rows[doc].media_sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_tensors(spark):
    docs = spark.createDataFrame([(1, "hello world " * 90, "z"), (2, None, "z")], "doc_id long, text string, media string")
    for r in jpeg.decode_column(jpeg.encode_column(docs)).collect():
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        images, coefficients = jpeg.read([bytes(r.media)])
        assert (rgb == jpeg.tensor(images[0], coefficients)).all()


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "a", None), (5, "`" * 1_000_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256) for r in jpeg.digest(jpeg.encode_column(docs)).collect())
    want = sorted((str(d), len(t or ""), len(jpeg.padded(t)), hashlib.sha256(jpeg.padded(t)).hexdigest()) for d, t, _ in rows)
    assert got == want
    assert jpeg.digest(jpeg.encode_column(docs.limit(0))).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")


def test_decoded_column_with_clashing_names_and_null_files(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "r"), (2, None, 6, "s")], "doc_id long, text string, height int, rgb string")
    media = jpeg.encode_column(docs).join(docs.select("doc_id", "height", "rgb"), "doc_id").withColumn("media", F.when(F.col("doc_id") == 1, F.col("media")))
    done = jpeg.decode_column(media)
    assert sorted(done.columns) == ["doc_id", "height", "media", "n_bytes", "rgb", "width"]
    got = {r.doc_id: r for r in done.collect()}
    assert len(got[1].rgb) == 3 * got[1].height * got[1].width and got[2].rgb is got[2].height is got[2].width is None
    with pytest.raises(ValueError):
        jpeg.decode_column(media.withColumnRenamed("media", "rgb"), "rgb")
