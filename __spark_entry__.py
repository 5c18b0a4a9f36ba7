
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import feed_mapping as feeds  # noqa: E402
from pkgwarden.functions import (  # noqa: E402
    archive_package,
    archive_version,
    contains_any,
    register_version_function,
    version_at_least,
    version_key,
    version_key_text,
    version_literal,
)
from pkgwarden.operators import (  # noqa: E402
    JoinLimits,
    SortKey,
    append_message,
    append_run,
    count_rows,
    key_violations,
    lookup_join,
    ordered,
    page,
    paged,
    pivot_keys,
    rows_absent,
    total_order,
    with_level,
)
from pkgwarden.plans import records  # noqa: E402
from pkgwarden.plans.advisories import flatten_advisories, vulnerability_lookup  # noqa: E402
from pkgwarden.plans.refresh import Feeds, PackageStore, PublishedVersion  # noqa: E402
from pkgwarden.plans.safety import (  # noqa: E402
    all_packages,
    package_safety_report,
    packages_search,
    parse_archive,
)
from pkgwarden.plans.search import search_packages  # noqa: E402
from pkgwarden.sources import feeds as readers  # noqa: E402
from pkgwarden.sources import tables  # noqa: E402
from pkgwarden.sources.schemas import LOGS  # noqa: E402
from pkgwarden.streaming import json_rows  # noqa: E402

# The operators of the training-data pipeline are an optional part: without it, or without what it
# needs, the other queries are there all the same.
try:
    import corpus_pipeline
    from pkgwarden.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

# Options of the delimited feeds, for writing test feeds.
CSV = {"sep": ";", "quote": '"', "escape": '"', "header": True}

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_ORDER = [SortKey("ts", descending=True), SortKey("event_id")]
SHIP_ORDER = [SortKey("l_shipdate", descending=True), SortKey("l_orderkey")]

_stores: dict[tuple[str, str], PublishedVersion] = {}


def entry(spark: SparkSession) -> DataFrame:
    """Safety report over current and archived package versions."""
    return safety_report(spark, "/root/testdata/sf0.001")


# ---- sources and tables --------------------------------------------------------------------


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch_path(spark, "packages.csv")
    feeds.catalogue(spark, sf_dir).write.options(**CSV).csv(path)
    return readers.read_catalogue(spark, path)


def scan_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch_path(spark, "advisories")
    feeds.advisories(spark, sf_dir).write.json(path)
    documents = readers.read_advisories(spark, path, one_record_per_line=True)
    return documents.select("id", F.posexplode("affected").alias("pos", "entry")).select(
        F.col("id").alias("osv_id"),
        "pos",
        F.col("entry.package.name").alias("name"),
        F.col("entry.package.ecosystem").alias("ecosystem"),
        F.coalesce(F.array_size("entry.ranges"), F.lit(-1)).alias("n_ranges"),
        _events_text(F.get(F.col("entry.ranges"), 0)["events"]).alias("events"),
    )


def _events_text(events: Column) -> Column:
    return F.array_join(
        F.transform(
            events,
            lambda e: F.concat(
                F.coalesce(e["introduced"], F.lit("-")),
                F.lit("/"),
                F.coalesce(e["fixed"], F.lit("-")),
            ),
        ),
        ",",
    )


def scan_kv_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch_path(spark, "release.json")
    feeds.key_values(spark, sf_dir).write.json(path)
    return readers.read_key_values(spark, path, one_record_per_line=True)


def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.scan(spark, f"{sf_dir}/events.parquet")
    return events.select("event_id", "user_id", F.col("event_type").alias("level"), "value")


def replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch_path(spark, "catalogue")
    tables.create_if_missing(spark, path, feeds.catalogue(spark, sf_dir).schema)
    return tables.replace(feeds.catalogue(spark, sf_dir), path)


def temp_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds.log_entries(spark, sf_dir).createOrReplaceTempView("session_log_entries")
    return spark.sql("SELECT event_id, level, msg FROM session_log_entries")


def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = feeds.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    known = feeds.table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return rows_absent(orders, known, "o_custkey", "c_custkey")


def append_if_absent_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same beyond the broadcast limits."""
    orders = feeds.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    known = feeds.table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    limits = JoinLimits(broadcast_rows=0)
    return rows_absent(orders, known, "o_custkey", "c_custkey", limits)


def _old_times(df: DataFrame, column: str, is_new: Column) -> DataFrame:
    """The time of the new row, which is the current time, is left out."""
    return df.withColumn(column, F.when(~is_new, F.col(column)))


def run_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "cran_packages_source": "packages",
        "cran_archive_source": "archive",
        "osv_source_pattern": "ALL",
        "status": "SUCCESS",
    }
    added = append_run(feeds.runs(spark, sf_dir), sources)
    return _old_times(added, "refresh_timestamp", F.col("cran_packages_source") == "packages")


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.scratch_path(spark, "logs")
    tables.create_if_missing(spark, path, LOGS)
    tables.append(feeds.log_entries(spark, sf_dir).select("ts", "msg"), path)
    # One more message, whose time comes from the default that the table declares.
    message = spark.range(0, 1, numPartitions=1).select(F.lit("appended").alias("msg"))
    tables.append(message, path)
    added = append_message(tables.scan(spark, path, LOGS), "refreshed")
    return _old_times(added, "ts", F.col("msg").isin("appended", "refreshed"))


def unique_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_violations(feeds.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def write_feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    """The mapped feeds as files in the shared folder."""
    base = tables.scratch_path(spark, "feeds")
    feeds.catalogue(spark, sf_dir).write.options(**CSV).csv(f"{base}/packages.csv")
    feeds.archive(spark, sf_dir).write.options(**CSV).csv(f"{base}/archive.csv")
    feeds.advisories(spark, sf_dir).write.json(f"{base}/ALL")
    feeds.key_values(spark, sf_dir).write.json(f"{base}/VERSION-INFO.json")
    return Feeds(base, json_lines=True)


def published(spark: SparkSession, sf_dir: str) -> PublishedVersion:
    """A version published from feeds written for this session; made once per session."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _stores:
        store = PackageStore(spark, tables.scratch_path(spark, "store"))
        _stores[known] = store.refresh(write_feeds(spark, sf_dir), "refreshed")
    return _stores[known]


def refresh_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).row_counts()


def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).package_safety_report()


def published_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).search_packages(term="ring", status="SAFE", format="ndjson")


def published_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the middle of the published report, read by its index."""
    version = published(spark, sf_dir)
    middle = version.entry["row_counts"]["package_safety_report"] // 2
    return version.report_page("version", "desc", 200, middle).rows


def published_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).search_packages(sort_by="published", limit=60, offset=100).rows


def late_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published archive files from a version on, by their stored keys."""
    files = published(spark, sf_dir).table("stage_cran_archive")
    late = F.col("version_key") >= version_literal(spark, "5.40")
    return files.filter(late).select("file_name", "Package", "Version")


def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    published(spark, sf_dir).register_views()
    return spark.sql(
        "SELECT r.status, r.osv_safety_status, count(*) AS n,"
        " count_if(r_ver(r.Version) >= r_ver('25.3-2')) AS n_late"
        " FROM package_safety_report r GROUP BY r.status, r.osv_safety_status"
    )


# ---- advisories and safety -----------------------------------------------------------------


def advisory_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_advisories(feeds.advisories(spark, sf_dir))
    return flat.withColumn("events", _events_text(F.col("events")))


def advisory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vulnerability_lookup(flatten_advisories(feeds.advisories(spark, sf_dir)))


def archive_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.archive(spark, sf_dir).select(
        "file_name",
        archive_package(F.col("file_name")).alias("Package"),
        archive_version(F.col("file_name")).alias("Version"),
    )


def _all_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_packages(feeds.catalogue(spark, sf_dir), feeds.archive(spark, sf_dir))


def union_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_packages(spark, sf_dir)


def version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_packages(spark, sf_dir).select(
        "Package", "Version", version_key_text(version_key(F.col("Version"))).alias("version_key")
    )


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_packages(spark, sf_dir).select(
        "Package",
        "Version",
        version_at_least(F.col("Version"), F.lit("25.3-2")).alias("at_least"),
    )


def version_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_version_function(spark)
    _all_packages(spark, sf_dir).createOrReplaceTempView("session_packages")
    return spark.sql(
        "SELECT status, count(*) AS n, count_if(r_ver(Version) >= r_ver('3.10')) AS n_late"
        " FROM session_packages GROUP BY status"
    )


def left_join_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = _all_packages(spark, sf_dir).select("Package", "Version", "status")
    return lookup_join(packages, advisory_lookup(spark, sf_dir), "Package")


def left_join_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join beyond the broadcast limit: keys with many entries are cut into cells."""
    parts = feeds.table(spark, sf_dir, "part").select(
        F.concat(F.lit("pkg"), F.col("p_partkey").cast("string")).alias("Package"), "p_name"
    )
    files = parse_archive(feeds.archive(spark, sf_dir)).select("Package", "Version", "size")
    limits = JoinLimits(broadcast_rows=0, cell_rows=8, cell_pairs=64)
    return lookup_join(parts, files, "Package", limits=limits)


def left_join_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with all parts by a key of many values: one hot by its rows, one by its entries,
    null and missing ones. The product grows as the tables do."""
    kind = F.col("event_type")
    k = F.when(kind == "view", 0).when(kind == "signup", F.col("event_id"))
    rows = feeds.table(spark, sf_dir, "events").select(
        "event_id", k.when(kind != "click", F.col("user_id")).alias("k")
    )
    lookup = feeds.table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") == 1, 1).otherwise(F.col("p_partkey")).alias("k"), "p_partkey"
    )
    limits = JoinLimits(broadcast_rows=0, cell_rows=2, cell_pairs=100)
    return lookup_join(rows, lookup, "k", limits=limits).select("event_id", "k", "p_partkey")


def safety_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_safety_report(
        feeds.catalogue(spark, sf_dir),
        feeds.archive(spark, sf_dir),
        advisory_lookup(spark, sf_dir),
    )


def safety_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = safety_report(spark, sf_dir)
    return report.groupBy("status", "osv_safety_status").agg(F.count(F.lit(1)).alias("n"))


def _report_of(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return package_safety_report(
        feeds.catalogue(spark, sf_dir),
        feeds.archive(spark, sf_dir),
        advisory_lookup(spark, sf_dir),
        status=status,
    )


def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_of(spark, sf_dir, "VULNERABLE")


def report_status_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_of(spark, sf_dir, "fixed")


def report_status_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_of(spark, sf_dir, "All")


def report_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the middle of the report, looked up: here 1,000 rows are treated as deep."""
    report = safety_report(spark, sf_dir)
    keys = [SortKey("Version", descending=True), SortKey("Package")]
    return page(report, keys, 200, report.count() // 2, top_k_rows=1_000)


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages_search(feeds.catalogue(spark, sf_dir), advisory_lookup(spark, sf_dir))


# ---- search, sort, page --------------------------------------------------------------------


def _search(spark: SparkSession, sf_dir: str, **parameters):
    return search_packages(
        feeds.catalogue(spark, sf_dir), advisory_lookup(spark, sf_dir), **parameters
    )


def search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, term="RING", format="ndjson")


def search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, term="%_9", format="ndjson")


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = feeds.table(spark, sf_dir, "documents")
    return documents.filter(contains_any(["text", "lang"], "ér")).select("doc_id", "lang")


def filter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, status="fixed", format="ndjson")


def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(
        spark,
        sf_dir,
        term="e",
        status="vulnerable",
        sort_by="version",
        sort_order="desc",
        limit=50,
        offset=10,
    )
    return found.rows.withColumn("total", F.lit(found.total).cast("bigint"))


def sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, sort_by="osv_id", format="ndjson")


def sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, sort_by="published", sort_order="DESC", format="ndjson")


def filter_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.logs(feeds.log_entries(spark, sf_dir), level="error", format="ndjson")


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.logs(feeds.log_entries(spark, sf_dir), level="error", limit=40).rows


def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(feeds.table(spark, sf_dir, "events"))


def count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(with_level(feeds.log_entries(spark, sf_dir), "error"))


def page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(feeds.log_entries(spark, sf_dir), EVENT_ORDER)


def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(feeds.log_entries(spark, sf_dir), EVENT_ORDER, limit=250, offset=1000)


def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle, looked up by counting: here 1,000 rows are treated as deep."""
    lines = feeds.table(spark, sf_dir, "lineitem")
    return page(lines, SHIP_ORDER, 200, lines.count() // 2, top_k_rows=1_000)


def page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(feeds.log_entries(spark, sf_dir), EVENT_ORDER, limit=100, offset=300).envelope()


def ndjson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(ordered(feeds.log_entries(spark, sf_dir), EVENT_ORDER))


def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, term="bolt", limit=30, offset=20).envelope()


# ---- releases and runs ---------------------------------------------------------------------


def kv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.release_info(feeds.key_values(spark, sf_dir))


def kv_pivot_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_keys(
        feeds.table(spark, sf_dir, "events"),
        {name: name for name in EVENT_TYPES},
        key="event_type",
        value="props",
        group_by=["user_id"],
    )


def record_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The described release is new to the history; its detection time is the current time."""
    history = feeds.releases(spark, sf_dir)
    info = records.release_info(feeds.key_values(spark, sf_dir)).withColumn(
        "r_version", F.concat(F.lit("R-"), F.col("r_version"))
    )
    added = records.record_release(info, history)
    return _old_times(added, "detected_at", F.col("r_version").startswith("R-"))


def release_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.release_history(feeds.releases(spark, sf_dir), limit=200, offset=1000).rows


def release_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.release_history(feeds.releases(spark, sf_dir), format="ndjson")


def refresh_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.refresh_log(feeds.runs(spark, sf_dir), limit=200, offset=1000).rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each reads the whole tables."""
    if llm_queries is None:
        return core_queries()
    return core_queries() | llm_queries.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The same results in SQL, where SQL can express them."""
    return core_oracle_sql() | (llm_queries.oracle_sql() if llm_queries else {})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries without those of the training-data pipeline."""
    return {
        "scan_csv": scan_csv,
        "scan_nested_json": scan_nested_json,
        "scan_kv_json": scan_kv_json,
        "scan_table": scan_table,
        "replace_table": replace_table,
        "temp_relation": temp_relation,
        "append_if_absent": append_if_absent,
        "append_if_absent_large": append_if_absent_large,
        "run_log_append": run_log_append,
        "log_append": log_append,
        "unique_key_check": unique_key_check,
        "refresh_publish": refresh_publish,
        "published_report": published_report,
        "published_search": published_search,
        "published_page_deep": published_page_deep,
        "published_search_page": published_search_page,
        "late_versions": late_versions,
        "sql_views": sql_views,
        "advisory_flatten": advisory_flatten,
        "advisory_lookup": advisory_lookup,
        "archive_parse": archive_parse,
        "union_catalogue": union_catalogue,
        "version_key": version_keys,
        "version_compare": version_compare,
        "version_function": version_function,
        "left_join_advisories": left_join_advisories,
        "left_join_cells": left_join_cells,
        "left_join_whole": left_join_whole,
        "safety_report": safety_report,
        "safety_counts": safety_counts,
        "report_status": report_status,
        "report_status_lower": report_status_lower,
        "report_status_all": report_status_all,
        "report_page_deep": report_page_deep,
        "packages_search": searchable,
        "search_multi": search_multi,
        "search_wildcard": search_wildcard,
        "search_documents": search_documents,
        "filter_status": filter_status,
        "search_combined": search_combined,
        "sort_asc": sort_asc,
        "sort_desc": sort_desc,
        "filter_level": filter_level,
        "log_page": log_page,
        "count_rows": count_all,
        "count_filtered": count_filtered,
        "page_first": page_first,
        "page_offset": page_offset,
        "page_deep": page_deep,
        "page_envelope": page_envelope,
        "search_envelope": search_envelope,
        "ndjson_rows": ndjson_rows,
        "kv_pivot": kv_pivot,
        "kv_pivot_grouped": kv_pivot_grouped,
        "record_release": record_release,
        "release_history": release_history,
        "release_export": release_export,
        "refresh_log": refresh_log,
    }


# ---- SQL checks ----------------------------------------------------------------------------

_REPORT = (
    '"Package", "Version", "Title", "Description", "Published", status, osv_id, osv_safety_status'
)
_SEARCH = (
    '"Package", "Title", "Description", "Published", "Version", "License", status, osv_id,'
    " osv_safety_status"
)
_EVENTS_TEXT = (
    "array_to_string(list_transform({}, lambda e:"
    " concat(coalesce(e.introduced, '-'), '/', coalesce(e.fixed, '-'))), ',')"
)


def _term(pattern: str) -> str:
    """At least one searched column matches the pattern."""
    searched = [
        '"Package"',
        '"Title"',
        '"Description"',
        '"Published"',
        '"Version"',
        "status",
        "osv_id",
        "osv_safety_status",
    ]
    return "(" + " OR ".join(f"{column} ILIKE '{pattern}'" for column in searched) + ")"


def core_oracle_sql() -> dict[str, str]:
    """The same results in SQL, written in the native forms of the other engine."""
    with_feeds, key = feeds.WITH_FEEDS, feeds.sql_version_key
    log_json = (
        "concat('{\"event_id\":', event_id, ',\"ts\":\"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'),"
        " '\",\"level\":', to_json(level), ',\"msg\":', to_json(msg), '}')"
    )
    package_json = "concat('{'" + "".join(
        f", CASE WHEN {column} IS NOT NULL THEN concat({separator}'\"{name}\":', to_json({column}))"
        " ELSE '' END"
        for separator, column, name in [
            ("", '"Package"', "Package"),
            ("',', ", '"Title"', "Title"),
            ("',', ", '"Description"', "Description"),
            ("',', ", '"Published"', "Published"),
            ("',', ", '"Version"', "Version"),
            ("',', ", '"License"', "License"),
            ("',', ", "status", "status"),
            ("',', ", "osv_id", "osv_id"),
            ("',', ", "osv_safety_status", "osv_safety_status"),
        ]
    ) + ", '}')"
    pivot = ", ".join(
        f"max(trim(props)) FILTER (event_type = '{name}') AS {name}" for name in EVENT_TYPES
    )
    release = (
        "SELECT max(trim(value)) FILTER (key = 'Release') AS r_version,"
        " max(trim(value)) FILTER (key = 'Nickname') AS nickname,"
        " CAST(max(trim(value)) FILTER (key = 'Date') AS DATE) AS release_date,"
        " max(trim(value)) FILTER (key = 'Devel') AS devel_version FROM key_values"
    )
    ship_order = (
        "l_shipdate DESC NULLS LAST, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,"
        " l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
    )
    return {
        "scan_csv": with_feeds + " SELECT * FROM catalogue",
        "scan_nested_json": with_feeds
        + f""" SELECT id AS osv_id, (i - 1)::INTEGER AS pos,
          affected[i].package.name AS name, affected[i].package.ecosystem AS ecosystem,
          coalesce(len(affected[i].ranges), -1)::INTEGER AS n_ranges,
          {_EVENTS_TEXT.format("affected[i].ranges[1].events")} AS events
          FROM documents_in, unnest(range(1, len(affected) + 1)) AS n(i)""",
        "scan_kv_json": feeds.WITH_KEY_VALUES + " SELECT * FROM key_values",
        "scan_table": "SELECT event_id, user_id, event_type AS level, value FROM events",
        "replace_table": with_feeds + " SELECT * FROM catalogue",
        "temp_relation": feeds.WITH_LOGS + " SELECT event_id, level, msg FROM log_entries",
        "append_if_absent": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
        " WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
        "append_if_absent_large": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
        " WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
        "run_log_append": feeds.WITH_RUNS
        + " SELECT * FROM runs UNION ALL SELECT (max(run_id) + 1)::INTEGER, NULL::TIMESTAMP,"
        " 'packages', 'archive', 'ALL', 'SUCCESS' FROM runs",
        "log_append": "SELECT ts, props AS msg FROM events UNION ALL"
        " SELECT NULL::TIMESTAMP, unnest(['appended', 'refreshed'])",
        "unique_key_check": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem"
        " GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL",
        "refresh_publish": with_feeds
        + " SELECT 'stage_cran_current' AS table_name, count(*) AS n_rows FROM catalogue"
        " UNION ALL SELECT 'stage_cran_archive', count(*) FROM archive"
        " UNION ALL SELECT 'osv_flat', count(*) FROM ranges_in"
        " UNION ALL SELECT 'vulnerability_lookup', count(*) FROM lookup"
        " UNION ALL SELECT 'packages_search', count(*) FROM searchable"
        " UNION ALL SELECT 'package_safety_report', count(*) FROM report"
        " UNION ALL SELECT unnest(['stage_r_info', 'r_release_history', 'data_refresh_log']), 1",
        "published_report": with_feeds + f" SELECT {_REPORT} FROM report",
        "published_search": with_feeds
        + f" SELECT {_SEARCH} FROM searchable"
        f" WHERE {_term('%ring%')} AND osv_safety_status = 'SAFE'",
        "published_page_deep": with_feeds
        + f' SELECT {_REPORT} FROM report ORDER BY "Version" DESC NULLS LAST, "Package", osv_id,'
        ' "Title", "Description", "Published", status, osv_safety_status'
        " LIMIT 200 OFFSET (SELECT count(*) // 2 FROM report)",
        "published_search_page": with_feeds
        + f' SELECT {_SEARCH} FROM searchable ORDER BY "Published", "Package", "Version", osv_id,'
        ' "Title", "Description", "License", status, osv_safety_status LIMIT 60 OFFSET 100',
        "late_versions": with_feeds
        + ' SELECT file_name, "Package", "Version" FROM archive_parsed WHERE '
        + key('"Version"')
        + " >= [5, 40]",
        "sql_views": with_feeds
        + " SELECT status, osv_safety_status, count(*) AS n,"
        f" count(*) FILTER ({key(chr(34) + 'Version' + chr(34))} >= [25, 3, 2]) AS n_late"
        " FROM report GROUP BY status, osv_safety_status",
        "advisory_flatten": with_feeds
        + f' SELECT osv_id, "Package", {_EVENTS_TEXT.format("events")} AS events FROM ranges_in',
        "advisory_lookup": with_feeds
        + ' SELECT "Package", osv_id, introduced_v, fixed_v FROM lookup',
        "archive_parse": with_feeds
        + ' SELECT file_name, "Package", "Version" FROM archive_parsed',
        "union_catalogue": with_feeds + " SELECT * FROM packages",
        "version_key": with_feeds
        + ' SELECT "Package", "Version", array_to_string(list_transform('
        + key('"Version"')
        + ", lambda n: coalesce(n::VARCHAR, '')), ',') AS version_key FROM packages",
        "version_compare": with_feeds
        + ' SELECT "Package", "Version", '
        + key('"Version"')
        + " >= [25, 3, 2] AS at_least FROM packages",
        "version_function": with_feeds
        + " SELECT status, count(*) AS n, count(*) FILTER ("
        + key('"Version"')
        + " >= [3, 10]) AS n_late FROM packages GROUP BY status",
        "left_join_advisories": with_feeds
        + ' SELECT "Package", "Version", status, osv_id, introduced_v, fixed_v'
        ' FROM packages LEFT JOIN lookup USING ("Package")',
        "left_join_cells": with_feeds
        + ' SELECT concat(\'pkg\', p_partkey) AS "Package", p_name, "Version", size FROM part'
        " LEFT JOIN archive_parsed ON concat('pkg', p_partkey) = \"Package\"",
        "left_join_whole": "WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 0"
        " WHEN event_type = 'signup' THEN event_id WHEN event_type <> 'click' THEN user_id END AS k"
        " FROM events), l AS (SELECT CASE WHEN p_size = 1 THEN 1 ELSE p_partkey END AS k, p_partkey"
        " FROM part) SELECT event_id, k, p_partkey FROM r LEFT JOIN l USING (k)",
        "safety_report": with_feeds + f" SELECT {_REPORT} FROM report",
        "safety_counts": with_feeds
        + " SELECT status, osv_safety_status, count(*) AS n FROM report GROUP BY ALL",
        "report_status": with_feeds
        + f" SELECT {_REPORT} FROM report WHERE osv_safety_status = 'VULNERABLE'",
        "report_status_lower": with_feeds
        + f" SELECT {_REPORT} FROM report WHERE osv_safety_status = 'FIXED'",
        "report_status_all": with_feeds + f" SELECT {_REPORT} FROM report",
        "report_page_deep": with_feeds
        + f' SELECT {_REPORT} FROM report ORDER BY "Version" DESC NULLS LAST, "Package",'
        ' "Title", "Description", "Published", status, osv_id, osv_safety_status'
        " LIMIT 200 OFFSET (SELECT count(*) // 2 FROM report)",
        "packages_search": with_feeds + f" SELECT {_SEARCH} FROM searchable",
        "search_multi": with_feeds + f" SELECT {_SEARCH} FROM searchable WHERE {_term('%ring%')}",
        "search_wildcard": with_feeds + f" SELECT {_SEARCH} FROM searchable WHERE {_term('%%_9%')}",
        "search_documents": "SELECT doc_id, lang FROM documents"
        " WHERE text ILIKE '%ér%' OR lang ILIKE '%ér%'",
        "filter_status": with_feeds
        + f" SELECT {_SEARCH} FROM searchable WHERE osv_safety_status = 'FIXED'",
        "search_combined": with_feeds
        + f" SELECT {_SEARCH}, count(*) OVER () AS total FROM searchable"
        f" WHERE {_term('%e%')} AND osv_safety_status = 'VULNERABLE'"
        ' ORDER BY "Version" DESC NULLS LAST, "Package", osv_id LIMIT 50 OFFSET 10',
        "sort_asc": with_feeds + f" SELECT {_SEARCH} FROM searchable ORDER BY osv_id, {_SEARCH}",
        "sort_desc": with_feeds
        + f' SELECT {_SEARCH} FROM searchable ORDER BY "Published" DESC, {_SEARCH}',
        "filter_level": feeds.WITH_LOGS + " SELECT * FROM log_entries WHERE level = 'error'",
        "log_page": feeds.WITH_LOGS
        + " SELECT * FROM log_entries WHERE level = 'error' ORDER BY ts, msg, event_id LIMIT 40",
        "count_rows": "SELECT count(*) AS n FROM events",
        "count_filtered": "SELECT count(*) AS n FROM events WHERE event_type = 'error'",
        "page_first": feeds.WITH_LOGS
        + " SELECT * FROM log_entries ORDER BY ts DESC NULLS LAST, event_id LIMIT 100",
        "page_offset": feeds.WITH_LOGS
        + " SELECT * FROM log_entries ORDER BY ts DESC NULLS LAST, event_id LIMIT 250 OFFSET 1000",
        "page_deep": f"SELECT * FROM lineitem ORDER BY {ship_order} "
        " LIMIT 200 OFFSET (SELECT count(*) // 2 FROM lineitem)",
        "page_envelope": feeds.WITH_LOGS
        + f' SELECT {log_json} AS json, 100::BIGINT AS "limit", 300::BIGINT AS "offset",'
        " (SELECT count(*) FROM log_entries) AS total FROM log_entries"
        " ORDER BY ts DESC NULLS LAST, event_id LIMIT 100 OFFSET 300",
        "search_envelope": with_feeds
        + f' SELECT {package_json} AS json, 30::BIGINT AS "limit", 20::BIGINT AS "offset",'
        f" count(*) OVER () AS total FROM searchable WHERE {_term('%bolt%')}"
        ' ORDER BY "Package", "Version", osv_id LIMIT 30 OFFSET 20',
        "ndjson_rows": feeds.WITH_LOGS + f" SELECT {log_json} AS json FROM log_entries",
        "kv_pivot": f"{feeds.WITH_KEY_VALUES} {release}",
        "kv_pivot_grouped": f"SELECT user_id, {pivot} FROM events GROUP BY user_id",
        "record_release": f"{feeds.WITH_KEY_VALUES}, found AS ({release})"
        " SELECT o_orderkey::VARCHAR AS r_version, o_orderpriority AS nickname,"
        " o_orderdate::DATE AS release_date, o_orderstatus AS devel_version,"
        " o_orderdate::TIMESTAMP AS detected_at FROM orders"
        " UNION ALL SELECT 'R-' || r_version, nickname, release_date, devel_version,"
        " NULL::TIMESTAMP FROM found",
        "release_history": feeds.WITH_RELEASES
        + " SELECT * FROM releases ORDER BY release_date DESC NULLS LAST, r_version, nickname,"
        " devel_version, detected_at LIMIT 200 OFFSET 1000",
        "release_export": feeds.WITH_RELEASES
        + " SELECT * FROM releases ORDER BY release_date DESC, r_version",
        "refresh_log": feeds.WITH_RUNS
        + " SELECT * FROM runs ORDER BY refresh_timestamp DESC NULLS LAST, run_id DESC"
        " LIMIT 200 OFFSET 1000",
    }
