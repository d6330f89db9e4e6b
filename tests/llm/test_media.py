import struct
import zlib

import numpy as np
import pytest

from pathloom.llm import media


def png_by_hand(image, kinds):
    """A PNG whose rows take turns among all five filters, written a byte at a time."""
    out, above = bytearray(), [0] * image.shape[1]
    for y, row in enumerate(image.tolist()):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for x, v in enumerate(row):
            left = row[x - 1] if x else 0
            corner = above[x - 1] if x else 0
            up = above[x]
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            out.append((v - [0, left, up, (left + up) // 2, paeth][kind]) & 255)
        above = row
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    data = zlib.compress(bytes(out))
    return media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"tEXt", b"a") + media.chunk(
        b"IDAT",
        data[:9],
    ) + media.chunk(b"IDAT", data[9:]) + media.chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4], [4, 4, 3, 2, 2, 1]])
def test_every_filter(kinds):
    image = np.random.default_rng(len(kinds)).integers(0, 256, (23, 64)).astype(np.uint8)
    assert np.array_equal(media.decode_png(png_by_hand(image, kinds)), image)


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (64, 1), (3, 5), (200, 64)])
def test_diagonals_of_all_shapes(shape):
    rng = np.random.default_rng(sum(shape))
    for image in (
        rng.integers(0, 256, shape).astype(np.uint8),
        np.full(shape, 255, np.uint8),
        (rng.integers(0, 2, shape) * 255).astype(np.uint8),
    ):
        for kinds in ([3], [4], [4, 3]):
            assert np.array_equal(media.decode_png(png_by_hand(image, kinds)), image)


def feature_by_hand(image):
    """Area means on a 32 x 32 grid, then cosine sums, all one by one."""
    from math import cos, floor, pi, sqrt

    h, w = image.shape

    def weights(n, k):
        a, b = k * n / 32, (k + 1) * n / 32
        return [(y, min(b, y + 1) - max(a, y)) for y in range(floor(a), min(n, floor(b) + 1)) if min(b, y + 1) > max(a, y)]

    small = [[sum(int(image[y, x]) * p * q for y, p in weights(h, i) for x, q in weights(w, j)) * 32 * 32 / (h * w) for j in range(32)] for i in range(32)]
    wave = [[cos(pi * k * (2 * x + 1) / 64) * sqrt((1 if k == 0 else 2) / 32) for x in range(32)] for k in range(8)]
    half = [[sum(wave[k][i] * small[i][j] for i in range(32)) for j in range(32)] for k in range(8)]
    low = [round(sum(half[k][j] * wave[m][j] for j in range(32)), 6) for k in range(8) for m in range(8)]
    middle = sorted(low[1:])[31]
    return f"{sum(1 << (63 - i) for i, x in enumerate(low) if x > middle):016x}"


def test_features_by_hand(docs):
    for r in docs.limit(12).collect():
        n, png = media.store(r["text"])
        image = media.decode_png(png)
        assert media.features(png)[-1] == feature_by_hand(image)
        assert image.tobytes()[:n] == (r["text"] or "").encode()


def test_own_images_and_broken_ones():
    for image in (
        np.zeros((1, 64), np.uint8),
        np.tile(np.arange(64, dtype=np.uint8), (9, 1)),
        np.arange(6400, dtype=np.int64).reshape(-1, 64).astype(np.uint8),
    ):
        data = media.encode_png(image)
        assert np.array_equal(media.decode_png(data), image)
        for at in (3, 20, len(data) // 2, len(data) - 6):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                media.decode_png(bytes(broken))
        with pytest.raises(ValueError):
            media.decode_png(data[:-5])


def test_columns(odd, none):
    import hashlib

    rows = media.with_features(odd).collect()
    assert len(rows) == 11
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (
            len(raw),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-64:]),
        )
        assert len(r["feature"]) == 16
    for r in media.with_media(odd).collect():
        assert media.decode_png(bytes(r["media"])).tobytes()[: r["n_bytes"]] == (r["text"] or "").encode()
    assert media.with_features(none).count() == 0


def test_hash_follows_low_frequencies():
    rng = np.random.default_rng(4)
    image = (np.add.outer(np.linspace(0, 120, 96), np.linspace(0, 120, 64))).astype(np.uint8)
    noisy = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, image.shape).astype(np.uint8)
    apart = lambda a, b: (int(media.dct_hash(a), 16) ^ int(media.dct_hash(b), 16)).bit_count()
    assert apart(image, noisy) < apart(image, other)


def test_query_reads_a_stored_column(spark, sf):
    """The query's images stand in a binary column of the shared folder, and what it says of them is true of the stored bytes."""
    import glob
    import hashlib

    from pathloom.llm import common, queries

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/media-*"))
    rows = {r["doc_id"]: r for r in queries.op7_media(spark, sf).collect()}
    (path,) = set(glob.glob(f"{folder}/media-*")) - before
    stored = spark.read.parquet(path)
    assert dict(stored.dtypes)["media"] == "binary"
    images = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    assert images.keys() == rows.keys()
    for i, png in images.items():
        r = rows[i]
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        assert r["payload_sha256"] == hashlib.sha256(media.decode_png(png).tobytes()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = media.with_features(docs).drop("text")
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(rows[i][c] for c in whole.columns) for i in rows)
