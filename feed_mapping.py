"""The feeds of the engine derived from the test tables, as DataFrames and as SQL.

Packages come from ``part``, archived files from ``lineitem``, one advisory document per part,
key/value records from ``orders``, log entries from ``events``. Every row of a table is used.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _resolved_once(build: Callable) -> Callable:
    """Keep the (unevaluated) frame that ``build`` defines, like a view of the session."""
    views: dict[tuple, DataFrame] = {}

    @functools.wraps(build)
    def view(spark: SparkSession, sf_dir: str, *name: str) -> DataFrame:
        known = (spark.sparkContext.applicationId, sf_dir, *name)
        if known not in views:
            views[known] = build(spark, sf_dir, *name)
        return views[known]

    return view


@_resolved_once
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


@_resolved_once
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    published = F.concat(F.lit("2024-01-"), F.lpad(_text(key % 28 + 1), 2, "0"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("pkg"), _text(key)).alias("Package"),
        F.concat(
            _text("p_size"),
            F.lit("."),
            F.when(key % 5 == 0, F.lit("a")).otherwise(_text(key % 10)),
        ).alias("Version"),
        F.col("p_name").alias("Title"),
        F.when(key % 4 != 0, F.col("p_type")).alias("Description"),
        published.alias("Published"),
        F.col("p_brand").alias("License"),
        F.concat(published, F.lit(" 08:00:00 UTC")).alias("Date/Publication"),
        F.col("p_size").alias("Size"),
    )


@_resolved_once
def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = F.concat(F.lit("pkg"), _text("l_partkey"))
    quantity = _text(F.col("l_quantity").cast("int"))
    version = F.when(F.col("l_suppkey") % 17 == 0, F.lit("x")).otherwise(
        F.concat(
            _text("l_linenumber"), F.lit("."), quantity, F.lit("-"), _text(F.col("l_suppkey") % 10)
        )
    )
    name = F.concat(package, F.lit("/"), package, F.lit("_"), version, F.lit(".tar.gz"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    return lines.select(
        name.alias("file_name"), F.concat(quantity, F.lit("K")).alias("size")
    )


def _event(introduced: Column | None, fixed: Column | None) -> Column:
    def text(value: Column | None) -> Column:
        return (F.lit(None) if value is None else value).cast("string")

    return F.struct(text(introduced).alias("introduced"), text(fixed).alias("fixed"))


def _affected(name: Column, ecosystem: Column, ranges: Column) -> Column:
    return F.struct(
        F.struct(name.alias("name"), ecosystem.alias("ecosystem")).alias("package"),
        ranges.alias("ranges"),
    )


@_resolved_once
def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part with two affected packages; every seventh is of ecosystem CRAN."""
    key = F.col("p_partkey")
    relevant = key % 7 == 0
    first = F.array(
        F.struct(
            F.array(
                _event(F.when(key % 2 == 0, F.lit("0")).otherwise(F.lit("3.10")), None),
                _event(
                    None,
                    F.when(
                        key % 3 == 0, F.concat(_text(F.col("p_size") % 7 + 1), F.lit(".20"))
                    ),
                ),
            ).alias("events")
        )
    )
    second = F.array(F.struct(F.array(_event(F.lit("2"), None)).alias("events")))
    first_ecosystem = F.when(~relevant | (key % 77 == 0), F.lit("PyPI")).otherwise(F.lit("CRAN"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("OSV-"), _text(key)).alias("id"),
        F.array(
            _affected(
                F.concat(F.lit("pkg"), _text(key)),
                first_ecosystem,
                F.when(key % 35 != 0, first),
            ),
            _affected(
                F.concat(F.lit("pkg"), _text(key + 1)),
                F.when(relevant, F.lit("CRAN")).otherwise(F.lit("npm")),
                second,
            ),
        ).alias("affected"),
    )


@_resolved_once
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key/value record per order; the order key decides which of the four keys it is."""
    part = F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        F.when(part == 0, F.lit("Release"))
        .when(part == 1, F.lit("Nickname"))
        .when(part == 2, F.lit("Date"))
        .otherwise(F.lit("Devel"))
        .alias("key"),
        F.concat(
            F.lit(" "),
            F.when(part == 0, _text("o_orderkey"))
            .when(part == 1, F.col("o_orderpriority"))
            .when(part == 2, day)
            .otherwise(F.concat(F.col("o_orderstatus"), _text("o_custkey"))),
        ).alias("value"),
    )


@_resolved_once
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries with a level."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("level"), F.col("props").alias("msg")
    )


@_resolved_once
def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases."""
    return table(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("r_version"),
        F.col("o_orderpriority").alias("nickname"),
        F.col("o_orderdate").cast("date").alias("release_date"),
        F.col("o_orderstatus").alias("devel_version"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("detected_at"),
    )


@_resolved_once
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as refresh runs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("int").alias("run_id"),
        F.col("ts").cast("timestamp_ntz").alias("refresh_timestamp"),
        F.concat(F.lit("packages-"), _text("user_id")).alias("cran_packages_source"),
        F.concat(F.lit("archive-"), _text("user_id")).alias("cran_archive_source"),
        F.col("props").alias("osv_source_pattern"),
        F.col("event_type").alias("status"),
    )


# ---- the same mapping for the SQL checks ---------------------------------------------------

_CATALOGUE_SQL = """
catalogue AS (
  SELECT concat('pkg', p_partkey) AS "Package",
         concat(p_size, '.', CASE p_partkey % 5 WHEN 0 THEN 'a' ELSE (p_partkey % 10)::VARCHAR END)
           AS "Version",
         p_name AS "Title",
         CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS "Description",
         concat('2024-01-', lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0')) AS "Published",
         p_brand AS "License",
         concat('2024-01-', lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0'), ' 08:00:00 UTC')
           AS "Date/Publication",
         p_size AS "Size"
  FROM part)"""

_ARCHIVE_SQL = """
archive AS (
  SELECT concat(pkg, '/', pkg, '_', ver, '.tar.gz') AS file_name,
         concat(l_quantity::INTEGER, 'K') AS size
  FROM (SELECT concat('pkg', l_partkey) AS pkg,
               CASE l_suppkey % 17 WHEN 0 THEN 'x'
                 ELSE concat(l_linenumber, '.', l_quantity::INTEGER, '-', l_suppkey % 10)
               END AS ver,
               l_quantity
        FROM lineitem)),
archive_parsed AS (
  SELECT file_name, size,
         split_part(file_name, '/', 1) AS "Package",
         regexp_extract(file_name, '_([0-9.-]+)\\.tar\\.gz$', 1) AS "Version"
  FROM archive)"""

_DOCUMENTS_SQL = """
documents_in AS (
  SELECT concat('OSV-', p_partkey) AS id,
         [{'package': {'name': concat('pkg', p_partkey),
                       'ecosystem': CASE WHEN p_partkey % 7 <> 0 OR p_partkey % 77 = 0
                                         THEN 'PyPI' ELSE 'CRAN' END},
           'ranges': CASE WHEN p_partkey % 35 <> 0 THEN
              [{'events': [{'introduced': CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '3.10' END,
                            'fixed': NULL::VARCHAR},
                           {'introduced': NULL::VARCHAR,
                            'fixed': CASE WHEN p_partkey % 3 = 0
                                          THEN concat(p_size % 7 + 1, '.20') END}]}] END},
          {'package': {'name': concat('pkg', p_partkey + 1),
                       'ecosystem': CASE WHEN p_partkey % 7 = 0 THEN 'CRAN' ELSE 'npm' END},
           'ranges': [{'events': [{'introduced': '2', 'fixed': NULL::VARCHAR}]}]}] AS affected
  FROM part)"""

_LOOKUP_SQL = """
ranges_in AS (
  SELECT d.id AS osv_id, a.entry.package.name AS "Package", r.span.events AS events
  FROM documents_in d, unnest(d.affected) AS a(entry), unnest(a.entry.ranges) AS r(span)
  WHERE a.entry.package.ecosystem = 'CRAN'),
lookup AS (
  SELECT osv_id, "Package",
         list_filter(list_transform(events, lambda e: e.introduced), lambda t: t IS NOT NULL)[1]
           AS introduced_v,
         list_filter(list_transform(events, lambda e: e.fixed), lambda t: t IS NOT NULL)[1]
           AS fixed_v
  FROM ranges_in)"""


def sql_version_key(text: str) -> str:
    """The version key in its native list form."""
    return (
        f"list_transform(str_split_regex({text}, '[.-]'),"
        " lambda part: TRY_CAST(part AS INTEGER))"
    )


def _classified_sql(name: str, packages: str) -> str:
    """Every package row with its advisories and the safety status."""
    version = sql_version_key('p."Version"')
    return f"""
{name} AS (
  SELECT p.*, l.osv_id,
         CASE WHEN l.osv_id IS NULL THEN 'SAFE'
              WHEN {version} >= {sql_version_key("l.fixed_v")} THEN 'FIXED'
              WHEN {version} >= {sql_version_key("l.introduced_v")} THEN 'VULNERABLE'
              ELSE 'SAFE' END AS osv_safety_status
  FROM {packages} p LEFT JOIN lookup l USING ("Package"))"""


_PACKAGES_SQL = """
packages AS (
  SELECT "Package", "Version", "Title", "Description", "Published", 'current' AS status
  FROM catalogue
  UNION ALL BY NAME
  SELECT "Package", "Version", 'archived' AS status FROM archive_parsed),
current_packages AS (
  SELECT * EXCLUDE ("Date/Publication", "Size"), 'current' AS status FROM catalogue)"""

_KEY_VALUES_SQL = """
key_values AS (
  SELECT ['Release', 'Nickname', 'Date', 'Devel'][o_orderkey % 4 + 1] AS key,
         ' ' || [o_orderkey::VARCHAR, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'),
                 concat(o_orderstatus, o_custkey)][o_orderkey % 4 + 1] AS value
  FROM orders)"""

_LOGS_SQL = """
log_entries AS (SELECT event_id, ts, event_type AS level, props AS msg FROM events)"""

_RUNS_SQL = """
runs AS (
  SELECT event_id::INTEGER AS run_id, ts AS refresh_timestamp,
         concat('packages-', user_id) AS cran_packages_source,
         concat('archive-', user_id) AS cran_archive_source,
         props AS osv_source_pattern, event_type AS status
  FROM events)"""

_RELEASES_SQL = """
releases AS (
  SELECT o_orderkey::VARCHAR AS r_version, o_orderpriority AS nickname,
         o_orderdate::DATE AS release_date, o_orderstatus AS devel_version,
         o_orderdate AS detected_at
  FROM orders)"""

WITH_FEEDS = "WITH " + ",".join(
    [
        _CATALOGUE_SQL,
        _ARCHIVE_SQL,
        _DOCUMENTS_SQL,
        _LOOKUP_SQL,
        _PACKAGES_SQL,
        _classified_sql("report", "packages"),
        _classified_sql("searchable", "current_packages"),
    ]
)
WITH_KEY_VALUES = "WITH " + _KEY_VALUES_SQL
WITH_LOGS = "WITH " + _LOGS_SQL
WITH_RUNS = "WITH " + _RUNS_SQL
WITH_RELEASES = "WITH " + _RELEASES_SQL
