"""Every query of the operators runs over the whole tables, and gives its SQL's rows where there is SQL."""

import duckdb
import pytest

from pathloom.llm import queries

TABLES = ["documents", "embeddings", "pages", "labels"]
COLUMNS = {
    "op1_pack": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_sentencepiece": "doc_id n_ids ids_crc32 restored",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_topk": "query_id rank vec_id score",
    "op5_shard": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op7_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_langid": "doc_id held_out lang_pred score",
    "op9_quality": "doc_id held_out score predicted",
    "op10_simhash": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert out.columns == COLUMNS[name].split()
    rows = out.collect()
    whole = {"page_id": "pages", "doc_id": "documents"}.get(out.columns[0])
    if whole:
        ids = {r[0] for r in spark.read.parquet(f"{sf}/{whole}.parquet").select(out.columns[0]).collect()}
        assert {r[0] for r in rows} == ids
    if name in queries.ORACLES:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = db.execute(queries.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(out.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in rows) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_revisits_against_sql(spark, tmp_path):
    """The given pages have no equal payloads of 1000 bytes and more; these have, also without an id."""
    big = "p" * 1500
    rows = [(
        i,
        f"http://h/{i}",
        big if i % 3 == 0 else big + "q" if i % 3 == 1 else "s" * (990 + i),
    ) for i in range(60)] + [(99, None, None), (98, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(map(str, r)) for r in queries.op6_warc(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(tuple(map(str, r)) for r in db.execute(queries.ORACLES["op6_warc"]).fetchall())
    assert sum("revisit" in r for r in got) > 35
