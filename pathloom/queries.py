"""The index's own queries over the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions import codec
from .operators import search as ops
from .operators import tree
from .plans import index, walk
from .sources import admin, dump, vfs
from .streaming import telemetry

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}
PREFIX = vfs.PREFIX
_UP = f"""
    up AS (SELECT id, parent AS cur, '/' || name AS path, 0 AS depth FROM hits
           UNION ALL SELECT up.id, d.parent, '/' || d.name || up.path, up.depth + 1 FROM up JOIN dirs d ON d.ino = up.cur WHERE up.cur <> 1 AND up.depth < 4097),
    top AS (SELECT id, arg_max(cur, depth) AS cur, arg_max(path, depth) AS path FROM up GROUP BY id),
    full_path AS (SELECT id, cur, CASE WHEN cur = 1 THEN '{PREFIX}' || path ELSE '<ino 0x' || lower(to_hex(cur)) || '>' || path END AS path FROM top)"""
_RESULT = "type, uid, size, mtime, ctime, path"


def _sql(where: str, select: str = f"SELECT {_RESULT} FROM hits JOIN full_path USING (id)") -> str:
    return f"WITH RECURSIVE {vfs.SQL}, hits AS (SELECT *, row_number() OVER () AS id FROM entries WHERE {where}), {_UP} {select}"


def _add(name: str, sql: str | None):
    def add(f: Run) -> Run:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    entries = vfs.entries(spark, sf)
    return entries, storage.stage(tree.last_sightings(entries), "dirs")


_NAMES = ["red_widget-1.o", "order-7", "EUROPE", "nobody"]
_IN = "name IN (" + ", ".join(f"'{n}'" for n in _NAMES) + ")"
#: Folders of published volumes by application and tables: what is searched is published once.
_PUBLISHED: dict[tuple[str, str, str], str] = {}


def _published(spark: SparkSession, sf: str, what: str, build: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _PUBLISHED:
        root = storage.new_path(spark, f"volumes-{what}")
        build(root)
        _PUBLISHED[key] = root
    return _PUBLISHED[key]


def publish_whole(spark: SparkSession, sf: str, root: str) -> None:
    """The driver's tables as one volume, with the paths of some names."""
    index.publish(vfs.entries(spark, sf).drop("volume"), root, "vol1", PREFIX, names=_NAMES)


def _whole(spark: SparkSession, sf: str) -> index.Volume:
    return index.open_volume(spark, _published(spark, sf, "whole", lambda root: publish_whole(spark, sf, root)), "vol1")


def _regions(spark: SparkSession, sf: str) -> str:
    """A folder with a volume for each region, and for one of them a staging copy and a partial walk of a few rows."""

    def build(root: str) -> None:
        entries = storage.stage(vfs.entries(spark, sf), "entries")
        regions = spark.read.parquet(f"{sf}/region.parquet").select(F.lower("r_name").alias("v")).orderBy("v").collect()  # five by the format
        for k, r in enumerate(regions):
            v = r["v"].replace(" ", "_")
            mine = entries.filter(F.col("volume") == r["v"]).drop("volume")
            index.publish(mine, root, v, PREFIX)
            if k == 0:
                index.publish(mine.filter("parent = 1"), root, f"{v}_new", PREFIX)
                index.publish(mine.filter("parent = 1"), root, v, PREFIX, complete=False)

    return _published(spark, sf, "regions", build)


def _search(name: str, query: ops.Query, where: str) -> None:
    _add(name, _sql(where))(lambda spark, sf: _whole(spark, sf).search(query))


def _re(pattern: str) -> str:
    return "regexp_matches(name, '" + pattern.replace("'", "''") + "')"


_search("search_prefix", ops.Query(r"^red_"), _re("^red_"))
_search("search_exact", ops.Query(r"^AFRICA$"), "name = 'AFRICA'")
_search("search_substring", ops.Query("widget-3"), "contains(name, 'widget-3')")
_search("search_regex", ops.Query(r"^(red|blue)_.*-[12]\.o$", "file"), _re(r"^(red|blue)_.*-[12]\.o$") + " AND type = 'f'")
_search("search_nocase", ops.Query(r"(?i)^CUSTOMER#0*1[0-9]$", "dir"), _re(r"(?i)^CUSTOMER#0*1[0-9]$") + " AND type = 'd'")
_search("search_full_scan", ops.Query(r"[g-m][^a-e]+[02468]\.f"), _re(r"[g-m][^a-e]+[02468]\.f"))
_search("search_class", ops.Query(r"\b[[:upper:]]+\s?[[:alpha:]]*$"), _re(r"\b[[:upper:]]+\s?[[:alpha:]]*$"))
_search("search_type", ops.Query("red", "symlink"), _re("red") + " AND type = 'l'")
_search("search_uid", ops.Query(r"\.o$", uid=7), _re(r"\.o$") + " AND uid = 7 AND type <> 'h'")
_search("search_uid_no_hardlink", ops.Query(r"^red", uid=0), _re("^red") + " AND uid = 0 AND type <> 'h'")


@_add(
    "type_counts",
    f"""
        WITH {vfs.SQL} SELECT count(*) AS entries, count(*) FILTER (type = 'f') AS files, count(*) FILTER (type = 'd') AS dirs,
            count(*) FILTER (type = 'l') AS symlinks, count(*) FILTER (type = 'h') AS hardlinks, count(*) FILTER (type NOT IN ('f','d','l','h')) AS special
        FROM entries
    """,
)
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tree.type_counts(vfs.entries(spark, sf))


@_add(
    "meta_counts",
    f"""
        WITH {vfs.SQL} SELECT count(*) AS entries, count(DISTINCT name) AS names, count(DISTINCT name) / CAST(count(*) AS DOUBLE) AS name_ratio,
            coalesce(max(ino), 0) AS max_ino
        FROM entries
    """,
)
def meta_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = vfs.entries(spark, sf).agg(
        F.count("*").alias("entries"),
        F.countDistinct("name").alias("names"),
        F.coalesce(F.max("ino"), F.lit(0)).alias("max_ino"),
    )
    return n.withColumn("name_ratio", F.col("names") / F.col("entries"))


_SEEN = "WITH s AS (SELECT event_id AS seq, CAST(1 AS BIGINT) AS parent, event_type AS name, user_id AS ino FROM events)"


@_add("dirs_last_sighting", f"{_SEEN} SELECT ino, arg_max(parent, seq) AS parent, arg_max(name, seq) AS name, max(seq) AS seq FROM s GROUP BY ino")
def dirs_last_sighting(spark: SparkSession, sf: str) -> DataFrame:
    return tree.last_sightings(vfs.sightings(spark, sf))


@_add("dup_dirs", f"{_SEEN} SELECT count(*) AS dirs, count(DISTINCT ino) AS distinct_dirs, count(*) - count(DISTINCT ino) AS dup_dirs FROM s")
def dup_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return tree.duplicate_dirs(vfs.sightings(spark, sf))


@_add("search_name_in", _sql(_IN))
def search_name_in(spark: SparkSession, sf: str) -> DataFrame:
    v = _whole(spark, sf)
    return ops.search_names(_NAMES, v.entries, v.dirs, v.prefix)


@_add("search_paths", _sql("type <> 'd' AND " + _re("^blue_.*-3"), "SELECT parent, ino, path FROM hits JOIN full_path USING (id)"))
def search_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Matches with their paths, level by level from their parents."""
    v = _whole(spark, sf)
    hits = ops.Query("^blue_.*-3").hits(v.entries).filter("type <> 'd'")
    return tree.with_paths(hits, v.dirs, v.prefix).select("parent", "ino", "path")


@_add("names_dictionary", f"WITH {vfs.SQL} SELECT name, count(*) AS n FROM entries GROUP BY name")
def names_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(spark, sf).names.select("name", "n")


@_add(
    "name_ids",
    f"""
        WITH {vfs.SQL} SELECT name, row_number() OVER (ORDER BY CAST(name AS BLOB)) - 1 AS id
        FROM (SELECT DISTINCT name
        FROM entries)
    """,
)
def name_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of the distinct names of a published volume, in order of their bytes."""
    return _whole(spark, sf).names.select("name", "id")


@_add("paths_all_dirs", _sql("type = 'd'", "SELECT ino, path FROM hits JOIN full_path USING (id)"))
def paths_all_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return tree.all_paths(_index(spark, sf)[1], PREFIX)


@_add("orphan_paths", _sql("type = 'd'", "SELECT ino, path FROM hits JOIN full_path USING (id) WHERE cur <> 1"))
def orphan_paths(spark: SparkSession, sf: str) -> DataFrame:
    # a path that didn't reach the root starts with a placeholder instead of the prefix
    return tree.all_paths(_index(spark, sf)[1], PREFIX).filter(~F.col("path").startswith(f"{PREFIX.rstrip('/')}/"))


@_add("named_paths", _sql(_IN, f"SELECT name, {_RESULT} FROM hits JOIN full_path USING (id) ORDER BY name, path"))
def named_paths(spark: SparkSession, sf: str) -> DataFrame:
    v = _whole(spark, sf)
    return ops.named_paths(_NAMES, v.entries, v.dirs, v.prefix).orderBy("name", "path")


@_add("named_path_lookup", _sql("name = 'red_widget-1.o'"))
def named_path_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A whole name looked up in a published volume, from the paths stored beside it."""
    return _whole(spark, sf).search(ops.Query(r"^red_widget-1\.o$"))


@_add(
    "multi_volume_search",
    _sql(_re("^order-1"), f"SELECT replace(volume, ' ', '_') AS volume, {_RESULT} FROM hits JOIN full_path USING (id)"),
)
def multi_volume_search(spark: SparkSession, sf: str) -> DataFrame:
    """All published volumes of a folder, staging and partial ones left out."""
    return index.search_all(spark, _regions(spark, sf), ops.Query("^order-1")).select("volume", *ops.RESULT)


@_add(
    "tsv_output",
    _sql(
        _re("^blue_"),
        "SELECT CASE WHEN type = 'h' THEN '-' ELSE CAST(uid AS VARCHAR) END || chr(9) || size || chr(9) || mtime || chr(9) || path AS line FROM hits JOIN full_path USING (id)",
    ),
)
def tsv_output(spark: SparkSession, sf: str) -> DataFrame:
    return ops.tsv(_whole(spark, sf).search(ops.Query("^blue_")))


@_add(
    "frag_object_names",
    """
        SELECT o_orderkey, printf('%x.%08x', 1000000000 + o_orderkey, o_orderkey * 16777216 % 4294967296) AS oid
        FROM orders
    """,
)
def frag_object_names(spark: SparkSession, sf: str) -> DataFrame:
    frag = F.col("o_orderkey") * (1 << 24) % (1 << 32)
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey",
        codec.object_name(F.col("o_orderkey") + 10**9, frag).alias("oid"),
    )


@_add("key_parse", r"""
    WITH k AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 4 WHEN 0 THEN '_head' WHEN 1 THEN '_' || printf('%x',
        p_partkey) WHEN 2 THEN '_zz' ELSE '' END AS key FROM part),
    s AS (SELECT *, regexp_extract(key, '^(.*)_([^_]*)$', 1, 's') AS n, regexp_extract(key, '^(.*)_([^_]*)$', 2, 's') AS x FROM k)
    SELECT p_partkey, key, CASE WHEN ok THEN n END AS name, CASE WHEN ok THEN CASE x WHEN 'head' THEN 'fffffffffffffffe' ELSE lower(x) END END AS snap,
        ok AS good
    FROM (SELECT *, contains(key, '_') AND (x = 'head' OR regexp_full_match(x, '[0-9a-fA-F]+')) AS ok FROM s)""")
def key_parse(spark: SparkSession, sf: str) -> DataFrame:
    k, part = F.col("p_partkey"), spark.read.parquet(f"{sf}/part.parquet")
    tail = F.when(k % 4 == 0, "_head").when(
        k % 4 == 1,
        F.concat(F.lit("_"), F.format_string("%x", k)),
    ).when(k % 4 == 2, "_zz").otherwise("")
    keys = part.select("p_partkey", F.concat(F.translate("p_name", " ", "_"), tail).alias("key"))
    name, snap, good = codec.key_columns(F.col("key"))
    return keys.select("p_partkey", "key", name.alias("name"), snap.alias("snap"), good.alias("good"))


@_add(
    "mode_types",
    """
        WITH m AS (SELECT o_orderkey, CAST(o_orderkey * 4096 % 65536 + 420 AS BIGINT) AS mode
        FROM orders) SELECT o_orderkey, mode, CASE mode & 61440 WHEN 16384 THEN 'd' WHEN 32768 THEN 'f' WHEN 40960 THEN 'l' ELSE 'o' END AS type
        FROM m
    """,
)
def mode_types(spark: SparkSession, sf: str) -> DataFrame:
    modes = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 4096 % 65536 + 420).alias("mode"))
    return modes.withColumn("type", codec.mode_type(F.col("mode")))


@_add(
    "latency_percentiles",
    """
        SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS p50,
            list_sort(list(value))[count(*) * 99 // 100 + 1] AS p99
        FROM events
        WHERE value IS NOT NULL
        GROUP BY 1
    """,
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.percentiles(spark.read.parquet(f"{sf}/events.parquet"), seconds=3600)


@_add("aimd_limit", """
    WITH RECURSIVE w AS (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, list_sort(list(value))[count(*) * 99 // 100 + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY window_start) AS k FROM w),
    f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(64 AS INTEGER) AS lim UNION ALL
          SELECT f.k + 1, CAST(CASE WHEN o.p99 > 400 THEN greatest(1, lim // 2) ELSE least(64, lim + 4) END AS INTEGER) FROM f JOIN o ON o.k = f.k + 1)
    SELECT window_start, p99, lim AS "limit" FROM f JOIN o USING (k)""")
def aimd_limit(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.controller(latency_percentiles(spark, sf), 400.0, 64).select("window_start", "p99", "limit")


@_add(
    "progress_pct",
    """
        SELECT event_type, count(*) / 60.0::DOUBLE AS rate, least(100.0, 100.0 * count(*) / 2000)::DOUBLE AS pct,
            CASE WHEN 2000 > count(*) THEN (2000 - count(*)) / (count(*) / 60.0::DOUBLE) END AS seconds_left
        FROM events
        GROUP BY event_type
    """,
)
def progress_pct(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    rate, pct, left = telemetry.progress(F.col("n"), F.lit(2000), F.lit(60.0))
    return n.select("event_type", rate.alias("rate"), pct.alias("pct"), left.alias("seconds_left"))


@_add(
    "parse_names",
    """
        SELECT DISTINCT trim(u) AS name
        FROM (SELECT unnest(string_split('plugins, ,cache,  index.php ,plugins', ',')) AS u)
        WHERE trim(u) <> ''
    """,
)
def parse_names(spark: SparkSession, sf: str) -> DataFrame:
    split = F.filter(F.transform(F.split(F.lit("plugins, ,cache,  index.php ,plugins"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return spark.range(1).select(F.explode(split).alias("name")).distinct()


@_add("volume_discovery", "SELECT lower(replace(r_name, ' ', '_')) AS v FROM region ORDER BY v")
def volume_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """The published volumes of a folder that also has staging copies and partial walks."""
    return spark.createDataFrame([(v,) for v in index.discover(spark, _regions(spark, sf))], "v string").orderBy("v")


@_add("decode_dentries", f"""
    WITH {vfs.SQL}, {dump.SQL}
    SELECT parent, CASE WHEN type <> '?' THEN name END AS name, CASE WHEN type <> '?' THEN snap = 'head' END AS head,
        CASE WHEN type <> '?' THEN type END AS type,
           CASE WHEN type <> '?' THEN ino END AS ino, CASE WHEN type <> '?' THEN uid END AS uid, CASE WHEN type <> '?' THEN size END AS size,
           CASE WHEN type <> '?' THEN mtime END AS mtime, CASE type WHEN '?' THEN NULL WHEN 'h' THEN 0 ELSE ctime END AS ctime,
               CASE WHEN type <> '?' THEN rctime END AS rctime,
           CASE WHEN type NOT IN ('?', 'h') THEN rfiles END AS rfiles, CASE WHEN type NOT IN ('?', 'h') THEN rsubdirs END AS rsubdirs,
           CASE WHEN type = 'd' THEN CASE WHEN ino % {dump.SPLIT} = 0 THEN 2 ELSE 1 END END AS fragments,
               type = '?' AS failed FROM records""")
def decode_dentries(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of a dump decoded from its bytes, with those that can't be."""
    rows = codec.decoded(dump.omap(spark, sf))
    parent = F.conv(F.substring_index("oid", ".", 1), 16, -10).cast("long")
    fragments = F.when(F.col("frags").isNotNull(), F.size("frags"))
    return rows.select(
        parent.alias("parent"),
        "name",
        "head",
        "type",
        "ino",
        "uid",
        "size",
        "mtime",
        "ctime",
        "rctime",
        "rfiles",
        "rsubdirs",
        fragments.alias("fragments"),
        F.col("error").isNotNull().alias("failed"),
    )


_REACHED = f"""WITH RECURSIVE {vfs.SQL}, {dump.SQL},
    inside_of AS (SELECT CAST(1 AS BIGINT) AS ino UNION ALL SELECT r.ino FROM records r JOIN inside_of i ON r.parent = i.ino WHERE r.type = 'd'),
    seen AS (SELECT r.* FROM records r JOIN inside_of i ON r.parent = i.ino)"""


def _walked(spark: SparkSession, sf: str) -> walk.Walk:
    return walk.walk(dump.omap(spark, sf), [0])


@_add("tree_walk", f"{_REACHED} SELECT parent, name, ino, type, uid, size, mtime FROM seen WHERE type <> '?' AND snap = 'head'")
def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    """What can be reached from the root of a dump; a directory whose parent isn't there, and all in it, can't."""
    return _walked(spark, sf).entries.select("parent", "name", "ino", "type", "uid", "size", "mtime")


@_add("scan_counters", f"""{_REACHED},
    live AS (SELECT * FROM seen WHERE type <> '?' AND snap = 'head'),
    asked AS (SELECT ino AS dir, rfiles + rsubdirs > 1 AS nonempty, unnest(CASE WHEN ino % {dump.SPLIT} = 0 THEN [0,
        1] ELSE [0] END) AS half FROM live WHERE type = 'd' UNION ALL SELECT 1, true, 0),
    held AS (SELECT parent AS dir, CASE WHEN parent <> 1 AND parent % {dump.SPLIT} = 0 THEN length(name) % 2 ELSE 0 END AS half,
        count(*) AS keys FROM records GROUP BY 1, 2),
    found AS (SELECT a.*, h.keys FROM asked a LEFT JOIN held h USING (dir, half))
    SELECT (SELECT count(*) FROM live) AS entries, (SELECT count(*) FROM live WHERE type = 'd') AS dirs,
        (SELECT count(*) FROM live WHERE type = 'd' AND ino % {dump.SPLIT} = 0) AS fragmented,
           (SELECT count(*) FROM seen WHERE type = '?') AS decode_errors, (SELECT count(*) FROM seen WHERE type <> '?' AND snap <> 'head') AS snap_skipped,
           (SELECT CAST(sum(CASE WHEN type = 'd' THEN rfiles + rsubdirs ELSE 1 END) AS BIGINT) FROM live WHERE parent = 1) AS expected,
           (SELECT count(keys) FROM found) AS objects, (SELECT CAST(coalesce(sum(greatest(1, ceil(keys / 1024.0))),
               0) AS BIGINT) FROM found WHERE keys IS NOT NULL) AS pages,
           (SELECT count(*) FROM found WHERE keys IS NULL AND NOT nonempty) AS enoent, (SELECT count(*) FROM found WHERE keys IS NULL AND nonempty) AS missed_dirs""")
def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    """All counters of a walk over a dump."""
    names = ["entries", "dirs", "fragmented", "decode_errors", "snap_skipped", "expected", "objects", "pages", "enoent", "missed_dirs"]
    return _walked(spark, sf).counters.select(*names)


@_add("expected_entries", f"{_REACHED} SELECT CAST(sum(CASE WHEN type = 'd' THEN rfiles + rsubdirs ELSE 1 END) AS BIGINT) AS expected FROM seen WHERE parent = 1 AND type <> '?' AND snap = 'head'")
def expected_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries that the root's own records promise, from a walk's first level."""
    return walk.walk(dump.omap(spark, sf), [0], max_levels=1).counters.select("expected")


@_add("crash_check", "SELECT * FROM (VALUES ('lost', true), ('whole', false)) t(volume, refused)")
def crash_check(spark: SparkSession, sf: str) -> DataFrame:
    """A volume whose entries were lost after it was published is refused, one that is whole isn't."""
    root = storage.new_path(spark, "volumes-crash")
    entries = vfs.entries(spark, sf).drop("volume").filter("parent = 1")
    out = []
    for v in ("lost", "whole"):
        version = index.publish(entries, root, v, PREFIX)
        if v == "lost":
            entries.limit(0).write.mode("overwrite").parquet(f"{root}/{v}/{version}/entries")
        try:
            index.open_volume(spark, root, v)
            out.append((v, False))
        except index.VolumeError:
            out.append((v, True))
    return spark.createDataFrame(out, "volume string, refused boolean")


@_add(
    "exists_probe",
    f"""
        WITH {vfs.SQL} SELECT EXISTS (SELECT 1
        FROM entries
        WHERE name = 'ASIA') AS found, EXISTS (SELECT 1
        FROM entries
        WHERE name = 'nobody') AS lost
    """,
)
def exists_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a name is there at all: a probe stops at the first row, and skips row groups by bounds and Bloom filter."""
    entries = _whole(spark, sf).entries
    has = lambda n: not entries.filter(F.col("name") == n).limit(1).isEmpty()
    return spark.createDataFrame([(has("ASIA"), has("nobody"))], "found boolean, lost boolean")


@_add(
    "stats_left_join",
    """
        SELECT c_custkey, coalesce(n, 0) AS n, coalesce(last, 0) AS last
        FROM customer
        LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last
        FROM orders
        GROUP BY o_custkey) ON o_custkey = c_custkey
    """,
)
def stats_left_join(spark: SparkSession, sf: str) -> DataFrame:
    busy = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"),
        F.max("o_orderkey").alias("last"),
    )
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").join(busy, "c_custkey", "left").select(
        "c_custkey",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("last", F.lit(0)).alias("last"),
    )


@_add("probe_lines", _sql(_re("^order-2") + " AND type = 'd'", "SELECT uid || chr(9) || path AS line FROM hits JOIN full_path USING (id)"))
def probe_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = _whole(spark, sf)
    return ops.short_tsv(tree.with_paths(ops.Query("^order-2", "dir").hits(v.entries), v.dirs, v.prefix))


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    """A cluster's report for each region, its nations the volumes."""
    volume = F.struct(F.struct(
        F.lower("n_name").alias("fs_name"),
        F.col("n_nationkey").alias("metadata_pool"),
        F.array(F.lit(0), F.col("n_nationkey").cast("int")).alias("in"),
    ).alias("mdsmap"))
    return spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(volume).alias("filesystems"))).alias("dump"))


@_add(
    "fs_dump",
    """
        SELECT lower(n_name) AS fs, CASE WHEN n_nationkey < 20 THEN n_name || '_meta' END AS metadata_pool, '0,' || n_nationkey AS ranks
        FROM nation
    """,
)
def fs_dump(spark: SparkSession, sf: str) -> DataFrame:
    pools = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey < 20").select(
        F.col("n_nationkey").alias("pool_id"),
        F.concat("n_name", F.lit("_meta")).alias("pool"),
    )
    return admin.filesystems(_nations(spark, sf), pools).withColumn("ranks", F.concat_ws(",", F.col("ranks").cast("array<string>")))


@_add(
    "placement",
    """
        SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'dc' || s_nationkey END AS bucket, CASE WHEN s_suppkey % 2 = 0 THEN 'dc1' ELSE '' END AS client,
            (s_suppkey % 3 > 0 AND s_suppkey % 2 = 0 AND s_nationkey <> 1) AS crosses
        FROM supplier
    """,
)
def placement(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda op, item: F.struct(F.lit(op).alias("op"), item.alias("item_name"))
    take = F.concat(F.lit("dc"), F.col("s_nationkey").cast("string"))
    steps = F.when(
        F.col("s_suppkey") % 3 > 0,
        F.array(step("set_tries", F.lit("")), step("take", F.concat(take, F.lit("~ssd"))), step("take", F.lit("other"))),
    ).otherwise(F.array(step("emit", F.lit(""))))
    rules = spark.read.parquet(f"{sf}/supplier.parquet").select(
        "s_suppkey",
        F.to_json(F.struct(steps.alias("steps"))).alias("rule"),
        F.when(F.col("s_suppkey") % 2 == 0, "host=h datacenter=dc1").otherwise("host=h").alias("location"),
    )
    bucket, place = admin.primary_bucket(F.col("rule")), F.col("location")
    return rules.select(
        "s_suppkey",
        bucket.alias("bucket"),
        admin.datacenter(place).alias("client"),
        admin.reads_cross(bucket, place).alias("crosses"),
    )


@_add("search_stats", f"WITH {vfs.SQL} SELECT count(*) AS candidates, count(DISTINCT parent) AS parents FROM entries WHERE {_re('^red_')}")
def search_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ops.Query("^red_").hits(_whole(spark, sf).entries).agg(
        F.count("*").alias("candidates"),
        F.countDistinct("parent").alias("parents"),
    )
