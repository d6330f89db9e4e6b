import zlib

from pathloom.llm import langid, quality, queries


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) > 0.98
    assert sum(1 - r["predicted"] for r in bad) / len(bad) > 0.75


def test_odd_rows(spark, odd, none):
    model = langid.fit(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == 11
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if not any(c.isalpha() for c in r["text"] or ""))
    assert all(r["lang_pred"] in ("en", "de", "fr") for r in rows if any(c.isalpha() for c in r["text"] or ""))
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0

    labels = spark.createDataFrame([(2, 0), (3, 1), (3, 0), (None, 1), (5, 1), (99, 1), (1, None)], "doc_id long, quality int")
    net = quality.fit(odd, labels)
    rows = quality.predict(odd, net).collect()
    assert len(rows) == 11
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    nothing = quality.fit(odd, labels.limit(0))
    assert quality.predict(odd, nothing).count() == 11
    assert quality.predict(none, net).count() == 0


def test_whole_texts_count():
    """A run of junk at the end of a long text changes its score, however long the text."""
    import numpy as np

    clean = "clean words stand here and there. " * 20
    junk = "w%%% or$$$ ds&&& " * 40
    net = quality.train([(1, clean[i:]) for i in range(40)] + [(0, clean[i:] + junk[i:]) for i in range(40)], epochs=20)
    assert net.score(clean * 400) > 0.5 > net.score(clean * 400 + junk)
    long = np.frombuffer((clean * 400).encode(), np.uint8)
    assert len(long) > quality.RUN * quality.STRIDE


def test_repeated_words_held_out(spark):
    """Held-out texts of label 0 with less than a tenth of distinct words are rejected; 8 bytes alone don't show them."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = queries.op9_quality(spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"),
        "doc_id",
    ).join(docs, "doc_id").filter("held_out").collect()
    words = [(r, (r["text"] or "").split()) for r in rows if r["quality"] == 0]
    repeated = [r for r, w in words if len(set(w)) < 0.1 * len(w)]
    bad, good = [r for r, _ in words], [r for r in rows if r["quality"] == 1]
    print(
        "kept of label 1:",
        sum(r["predicted"] for r in good),
        len(good),
        "rejected of label 0:",
        sum(1 - r["predicted"] for r in bad),
        len(bad),
        "of repeated:",
        sum(1 - r["predicted"] for r in repeated),
        len(repeated),
    )
    assert len(repeated) > 20
    assert sum(1 - r["predicted"] for r in repeated) / len(repeated) > 0.95
    assert sum(r["predicted"] for r in good) / len(good) > 0.98


def test_repeat_marks(monkeypatch):
    """A byte is marked where the four up to it stood at most 64 bytes earlier without overlap, over the edges of runs too."""
    import random

    monkeypatch.setattr(quality, "RUN", 100)
    rng = random.Random(2)
    for n in (0, 1, 3, 40, 99, 100, 101, 103, 104, 250, 700):
        marked = quality.windows("".join(rng.choice("ab") for _ in range(n)))
        data = bytes((marked & 255).tolist())
        want = [any(i - 3 >= lag and any(data[i - 3 : i + 1]) and data[i - 3 - lag : i + 1 - lag] == data[i - 3 : i + 1] for lag in range(
            4,
            65,
        )) for i in range(len(data))]
        assert (marked >= 256).tolist() == want


def test_document_frequencies_are_those_of_all_rows(spark):
    """The sample decides what the classifier is fitted on, not how often a slot occurs."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    odd = spark.createDataFrame([(-1, "123 %", "en"), (-2, None, "en"), (-3, "no language", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("doc_id", "text", "lang").unionByName(odd), sample=5)
    texts = [found for r in docs.collect() if r["lang"] is not None and (found := langid.grams(r["text"])) is not None]
    df = np.zeros(langid.DIMENSIONS)
    for slots, _ in texts:
        df[slots] += 1
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + df)) + 1)


def test_grams_by_hand():
    """Slots and counts of all 1- to 3-grams, hashed one by one in whole numbers."""
    from collections import Counter

    for text in ("Ab c", "é1x--Yß", "漢字 a", "a" * 50, "  x ", "ÄÖ. z"):
        letters = "".join(c.lower()[0] if ord(c) < langid._TABLE and c.isalpha() else c if c.isalpha() else " " for c in text)
        while "  " in letters:
            letters = letters.replace("  ", " ")
        a, cut = [ord(c) for c in f" {letters} "], 0xFFFFFFFF
        two = lambda i: ((a[i] * 0x85EBCA6B + a[i + 1]) * 0xC2B2AE35 + 1) & cut
        hashes = [a[i] * 0x9E3779B1 & cut for i in range(1, len(a) - 1)] + [two(i) for i in range(len(a) - 1)]
        hashes += [((two(i) + a[i + 2]) * 0x27D4EB2F + 2) & cut for i in range(len(a) - 2)]
        slots = Counter(((h ^ h >> 15) * 0x2C1B3C6D & cut) >> 17 for h in hashes)
        found = langid.grams(text)
        assert dict(zip(*[x.tolist() for x in found], strict=True)) == slots, text


def test_regression_by_hand():
    """Follow-the-regularised-leader with both penalties, a coordinate at a time."""
    from math import exp, sqrt

    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(lang, np.array(sorted(rng.choice(20, 4, replace=False) + 5 * k)), rng.integers(1, 4, 4)) for k, lang in enumerate("abc") for _ in range(12)]
    alpha, beta, l1, l2, seed = 0.5, 1.0, 0.02, 0.05, 7
    model = langid.train(rows, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    fit = np.random.default_rng(seed).permutation(len(rows))[len(rows) // 5 :]
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0)) <= l1:
            return 0.0
        return ((l1 if z[key] > 0 else -l1) - z[key]) / ((beta + sqrt(n[key])) / alpha + l2)

    for epoch in range(2):
        for i in np.random.default_rng(seed + epoch).permutation(fit):
            slots, x = model.vector(rows[i][1:])
            w = {(s, k): weight((s, k)) for s in slots for k in range(3)}
            sums = [sum(v * w[s, k] for s, v in zip(slots, x)) for k in range(3)]
            p = [exp(t - max(sums)) for t in sums]
            for k in range(3):
                error = p[k] / sum(p) - ("abc"[k] == rows[i][0])
                for s, v in zip(slots, x):
                    g, old = error * v, n.get((s, k), 0.0)
                    z[s, k] = z.get((s, k), 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / alpha * w[s, k]
                    n[s, k] = old + g * g
    for s in [*range(32), langid.DIMENSIONS]:
        for k in range(3):
            assert abs(model.weights[s, k] - weight((s, k))) < 1e-9
    assert (model.weights == 0).mean() > 0.9


def test_network_by_hand():
    """Each filter's largest sum over all windows, then the logistic layer."""
    from math import exp, tanh

    import numpy as np

    rng = np.random.default_rng(3)
    net = quality.Network(
        rng.normal(0, 1, (quality.WIDTH, 512, quality.FILTERS)).astype(np.float32),
        rng.normal(0, 1, quality.FILTERS).astype(np.float32),
        rng.normal(0, 1, quality.FILTERS),
        0.3,
    )
    for text in ("", "abc", "some words, some words and é", "x" * 41):
        data = quality.windows(text).tolist()
        z = 0.3
        for f in range(quality.FILTERS):
            best = max(sum(float(net.taps[j, data[at + j], f]) for j in range(quality.WIDTH)) for at in range(
                0,
                len(data) - quality.WIDTH + 1,
                quality.STRIDE,
            ))
            z += tanh(max(best + float(net.bias[f]), 0)) * float(net.out[f])
        assert abs(net.score(text) - 1 / (1 + exp(-z))) < 1e-4


def error_of(scores, truth, bins=10):
    """The expected calibration error: how far scores and hits are apart, by bins of the score."""
    groups = {}
    for s, t in zip(scores, truth):
        groups.setdefault(min(bins - 1, int(s * bins)), []).append((s, t))
    return sum(abs(sum(s for s, _ in g) - sum(t for _, t in g)) for g in groups.values()) / len(scores)


def test_scores_are_calibrated(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in queries.op8_langid(spark, sf).join(
        docs,
        "doc_id",
    ).collect() if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    lang = error_of([r["score"] for r in rows], [r["lang"] == r["lang_pred"] for r in rows])
    rows = queries.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = error_of([r["score"] for r in rows], [r["quality"] for r in rows])
    print("calibration errors:", lang, good)
    assert lang < 0.03 and good < 0.03


def test_long_texts_are_learned_from(spark, monkeypatch):
    """A labelled text of any length is in the sample, whole; the sample ends where its bytes do."""
    learned = []
    monkeypatch.setattr(quality, "train", lambda rows, **more: learned.append((rows, more)))
    long = "long text " * 20_000
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "other"), (4, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    quality.fit(docs, labels)
    assert sorted(learned[0][0]) == sorted([(0, long), (1, "short"), (1, "other"), (1, "other")])
    assert learned[0][1] == {"odds": 3.0}
    quality.fit(docs, labels, most=1)
    assert len(learned[1][0]) == 1
