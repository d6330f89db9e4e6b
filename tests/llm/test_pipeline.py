"""Each stage of the corpus pipeline against a brute-force version on its own input, and the whole run against the stages."""

import zlib

import corpus_pipeline as pipeline
import pytest
from test_packing import brute, check
from test_simhash import components_by_hand, print_by_hand

from pathloom.llm import langid, packing, quality


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def learn(sf, spark, docs):
    """The stages' models, learned from the same rows as theirs."""
    known = {r["doc_id"] for r in docs.select("doc_id").collect()}
    tell = lambda parts, held: [(i,) for i in known if i is not None and zlib.crc32(str(i).encode()) % parts != held]
    some = docs.join(spark.createDataFrame(tell(3, 1), "doc_id long"), "doc_id", "left_semi")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marked = [i for (i,) in {tuple(r) for r in labels.select("doc_id").collect()} if i is not None and zlib.crc32(str(i).encode()) % 5]
    return langid.fit(some), lambda kept: quality.fit(
        kept,
        labels.join(spark.createDataFrame([(i,) for i in marked], "doc_id long"), "doc_id", "left_semi"),
    )


def keep_one_by_hand(table):
    """table: rows as tuples, id and text first; of each component the row with the smallest id stays."""
    order = sorted(range(len(table)), key=lambda k: (table[k][0] is None, table[k][0] or 0, k))
    found = components_by_hand([(place, print_by_hand(table[k][1])) for place, k in enumerate(order)])
    return sorted([table[order[place]] for place, _, least in found if place == least], key=str)


def test_stages_and_run(spark, sf, docs):
    model, net_of = learn(sf, spark, docs)
    sure = [r for r in rows(docs) if (p := model.predict(r[1]))[0] != langid.UNKNOWN and p[1] >= pipeline.LEAST_SURE]
    first = pipeline.language(spark, docs, sf)
    assert first.columns == docs.columns
    assert rows(first) == sure
    assert 0 < len(sure)

    net = net_of(first)
    good = [r for r in sure if net.score(r[1]) >= quality.THRESHOLD]
    second = pipeline.good(spark, first, sf)
    assert second.columns == docs.columns
    assert rows(second) == good
    assert 0 < len(good) < docs.count()

    third = pipeline.dedup(spark, second, sf)
    single = keep_one_by_hand(good)
    assert third.columns == docs.columns
    assert rows(third) == single
    assert 0 < len(single) < len(good)

    out = pipeline.run(spark, sf).collect()
    assert sorted([tuple(r)[:5] for r in out], key=str) == brute([(r[0], r[1]) for r in single])
    assert check(out) <= packing.lower_bound([r["length"] for r in out]) * 1.02 + 1


def test_stages_are_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality", "near_dedup", "packing"]


def test_clean_documents_stay(spark):
    """On more rows: of labelled good documents with words, the filters lose hardly any."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    for stage in (pipeline.language, pipeline.good):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()} & clean
        docs = stage(spark, docs, sf)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()} & clean
        assert len(after) >= 0.97 * len(before)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]])
def test_odd_rows(spark, sf, odd, none, stage):
    """Nulls, empty and long texts, repeated rows and clashing columns: rows that stay are as they were."""
    kept = stage(spark, odd, sf)
    assert kept.schema.names == odd.schema.names
    assert [f.dataType for f in kept.schema] == [f.dataType for f in odd.schema]
    before = rows(odd)
    assert all(r in before for r in rows(kept))
    assert stage(spark, none, sf).count() == 0


def test_language_rejects_what_has_no_letter(spark, sf, odd):
    kept = pipeline.language(spark, odd, sf).collect()
    assert kept and all(any(c.isalpha() for c in r["text"]) for r in kept)
    assert {r["score"] for r in kept} <= {"x", None}


def test_empty_tables(spark, tmp_path, none, sf):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert out.count() == 0


def test_without_labelled_languages_texts_with_letters_stay(spark, sf, odd, none):
    """Where no row to learn from has a language, none can be judged: only null texts and texts without letters go."""
    held = odd.filter("crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1")
    assert held.filter("lang is not null").count()
    for docs in (odd.selectExpr(*[c if c != "lang" else "cast(null as string) as lang" for c in odd.columns]), held):
        got = pipeline.language(spark, docs, sf)
        assert got.columns == docs.columns
        want = [tuple(r) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
        assert want
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert pipeline.language(spark, none, sf).count() == 0
