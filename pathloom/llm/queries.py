"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, langid, media, packing, quality, sentencepiece_fst, sharding, simhash, topk, url_filter, warc

RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_fst.with_digest(docs).drop("text")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(
        pages,
        url_filter.rule_table(spark, url_filter.parse_rules(RULES)),
    ).select("page_id", "host", "path", "rule", "verdict")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.topk(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(table(spark, sf_dir, "documents"), 16)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = common.stage(media.with_media(docs).drop("text"), "media")
    return media.read_features(stored).drop("media")


def _learnable(docs: DataFrame, parts: int, held: int):
    """Whether crc32(doc_id) mod ``parts`` is not ``held``; a null id is neither learned from nor held out."""
    return common.crc_mod(F.col("doc_id"), parts) != held


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(_learnable(docs, 3, 1)))
    found = langid.predict(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.filter(_learnable(labels, 5, 0)))
    found = quality.predict(docs.select("doc_id", "text"), net).drop("text")
    return found.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pack,
    op2_sentencepiece,
    op3_url_filter,
    op4_topk,
    op5_shard,
    op6_warc,
    op7_media,
    op8_langid,
    op9_quality,
    op10_simhash,
)}

_HOST = "CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END"

ORACLES: dict[str, str] = {
    "op3_url_filter": f"""
        WITH r(host, path, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com',
            '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, 'allow') AS verdict
        FROM p LEFT JOIN LATERAL (
            SELECT r.host || r.path AS rule, r.v FROM r
            WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            ORDER BY length(r.host) + length(r.path) DESC LIMIT 1) b ON true""",
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
        n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20""",
    # the checksum from its table, a byte at a time
    "op5_shard": """
        WITH bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i)),
        crc AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS t FROM bits),
        d AS (SELECT doc_id, coalesce('=' || source, '') AS src, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
                     xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(
                             regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                         lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) AS text_crc32
              FROM documents, crc),
        m AS (SELECT *, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32) AS mixed FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY mixed, doc_id NULLS FIRST, size, text_crc32) AS k,
                     count(*) OVER (PARTITION BY src) AS n, count(*) OVER () AS total FROM m),
        f AS (SELECT *, (k - CAST('0x' || substr(md5('42:' || src), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) / n AS fraction FROM r),
        p AS (SELECT *, row_number() OVER (ORDER BY fraction, src, mixed, doc_id NULLS FIRST, size, text_crc32) - 1 AS place FROM f)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard,
               CAST(place - (place * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h FROM p),
        g AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
               CASE WHEN g.top IS NOT NULL AND g.top <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.top IS NOT NULL AND g.top <> d.page_id THEN g.top END AS refers_to
        FROM d LEFT JOIN g ON d.n >= 1000 AND d.h = g.h""",
}
