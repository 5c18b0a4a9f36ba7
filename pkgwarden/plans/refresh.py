"""Refresh job: stage the feeds into a new version and publish it at once.

Every version lives in a directory of its own. Its tables are written and checked first; then the
record of the run is created under the number that follows the version it began with. A number can
be created once, so of refreshes that began with the same version one is published and the others
raise, and the number is the run's id. Readers look the newest record up once, so they see a whole
version or the one before; whatever a failed refresh left behind is never named.

The records are the run log, and hold the releases that a run has found new, so history and run log
grow by the new rows only and are shared by all versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.functions.version import register_version_function, version_key
from pkgwarden.operators.filters import status_is, wanted_status
from pkgwarden.operators.joins import DEFAULT_LIMITS, JoinLimits, Size, measure
from pkgwarden.operators.ordering import SortKey, total_order
from pkgwarden.operators.paging import DEFAULT_LIMIT, DEFAULT_OFFSET, Page
from pkgwarden.operators.rank_index import ROW, IndexedTable, write_index, write_rows
from pkgwarden.operators.skip_table import SkipTable, write_skip_table
from pkgwarden.operators.spread import SPREAD, with_spread
from pkgwarden.operators.tables import KeyViolation, insert_if_absent, now
from pkgwarden.plans import records
from pkgwarden.plans.advisories import (
    DEFAULT_ECOSYSTEM,
    flatten_advisories,
    vulnerability_lookup,
    with_version_keys,
)
from pkgwarden.plans.safety import (
    REPORT_COLUMNS,
    SEARCH_COLUMNS,
    VERSION_KEY,
    package_safety_report,
    packages_search,
    parse_archive,
)
from pkgwarden.plans.search import (
    DEFAULT_ORDER,
    NDJSON,
    SEARCHED,
    SORTABLE,
    search_view,
    sort_keys,
)
from pkgwarden.sources import feeds, files, tables
from pkgwarden.sources.numbered import NumberedLog
from pkgwarden.sources.schemas import (
    LOGS,
    REFRESH_LOG,
    RELEASE_HISTORY,
    STRING,
    TIME,
    struct,
)

# Names of the relations that SQL users see, and the status of a finished run.
CURRENT = "stage_cran_current"
ARCHIVE = "stage_cran_archive"
FLAT = "osv_flat"
LOOKUP = "vulnerability_lookup"
RELEASE = "stage_r_info"
HISTORY = "r_release_history"
RUNS = "data_refresh_log"
SEARCH = "packages_search"
REPORT = "package_safety_report"
LOG = "logs"
STATUS = "osv_safety_status"
SUCCESS = "SUCCESS"

# The tables that a refresh writes, and all relations of a version.
STAGED = (CURRENT, ARCHIVE, FLAT, LOOKUP, RELEASE, SEARCH, REPORT)
VERSIONED = (*STAGED, HISTORY, RUNS)

#: The record of a run: what it has published, its row of the run log, and the releases it found new.
COMMIT = T.StructType(
    [
        *struct(
            version=STRING,
            published_at=TIME,
            row_counts=T.MapType(STRING, T.LongType()),
            schemas=T.MapType(STRING, STRING),
            lookup_bytes=T.LongType(),
            released=T.ArrayType(RELEASE_HISTORY),
        ).fields,
        *REFRESH_LOG.fields,
    ]
)


class PublicationConflict(RuntimeError):
    """Another refresh has published since this one began; this one is not published."""


@dataclass(frozen=True)
class Feeds:
    """Where the feeds are, below one base directory, and how they are laid out."""

    base_dir: str
    packages: str = "packages.csv"
    archive: str = "archive.csv"
    advisories: str = "ALL/*.json"
    release: str = "VERSION-INFO.json"
    json_lines: bool = False
    multi_line: bool | None = None
    catalogue_schema: T.StructType | None = None
    archive_schema: T.StructType | None = None
    ecosystem: str = DEFAULT_ECOSYSTEM

    def path(self, file: str) -> str:
        return feeds.feed_path(self.base_dir, file)


@dataclass
class PackageStore:
    """Published tables below one root directory that all executors share."""

    spark: SparkSession
    root: str
    limits: JoinLimits = field(default=DEFAULT_LIMITS)

    # ---- published version -------------------------------------------------------------

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def commits(self) -> NumberedLog:
        """The records of all published runs, by run id."""
        return NumberedLog(self.spark, self._path("runs"), COMMIT)

    @property
    def messages(self) -> NumberedLog:
        return NumberedLog(self.spark, self._path(LOG), LOGS)

    def manifest(self) -> Row | None:
        """The record of the current version, or none before the first refresh."""
        return self.commits.newest()

    def current(self) -> PublishedVersion:
        """The current version; keep it for queries that belong together."""
        row = self.manifest()
        if row is None:
            raise LookupError(f"nothing has been published below {self.root}")
        return PublishedVersion(self, row)

    # ---- log messages ------------------------------------------------------------------

    def log_table(self) -> DataFrame:
        return self.messages.rows().select(*LOGS.names)

    def log(self, message: str) -> None:
        """Append one message with the current time."""
        self.messages.append({"ts": self._now(), "msg": message})

    def _now(self) -> datetime:
        return self.spark.range(1).select(now()).first()[0]

    def logs(self, level=None, limit=None, offset=None, format=None) -> DataFrame | Page:
        return records.logs(self.log_table(), level, limit, offset, format)

    def log_count(self) -> int:
        return records.log_count(self.log_table())

    # ---- refresh -----------------------------------------------------------------------

    def refresh(self, source: Feeds, message: str) -> PublishedVersion:
        """Stage all feeds, publish them as the next version, then log the message.

        Raises ``PublicationConflict`` if another refresh published meanwhile.
        """
        spark, previous = self.spark, self.manifest()
        run_id = 1 + (previous["run_id"] if previous else 0)
        version = f"versions/{uuid.uuid4().hex}"
        known = self._history(run_id - 1)

        def stage(name: str, df: DataFrame) -> DataFrame:
            return tables.replace(df, self._path(f"{version}/{name}"))

        def stage_lookup() -> tuple[DataFrame, DataFrame, Size]:
            documents = feeds.read_advisories(
                spark, source.path(source.advisories), source.json_lines
            )
            flat = stage(FLAT, flatten_advisories(documents, source.ecosystem))
            keyed = with_version_keys(vulnerability_lookup(flat))
            lookup = stage(LOOKUP, with_spread(keyed))
            return flat, lookup, measure(lookup)

        def stage_releases() -> tuple[DataFrame, list[dict]]:
            described = feeds.read_key_values(
                spark, source.path(source.release), source.json_lines
            )
            release = stage(RELEASE, records.release_info(described))
            # A descriptor tells of one release, so this is one row at most.
            new = insert_if_absent(release, known, "r_version", {"detected_at": now()}).collect()
            if any(row["r_version"] is None for row in new):
                raise KeyViolation(f"{HISTORY}: a release has no version")
            return release, [row.asDict() for row in new]

        catalogue, archive, (flat, lookup, size), (release, released) = _side_by_side(
            spark,
            lambda: stage(CURRENT, self._catalogue(source)),
            lambda: stage(ARCHIVE, self._archive(source)),
            stage_lookup,
            stage_releases,
        )

        def stage_classified(name: str, df: DataFrame) -> DataFrame:
            # Rows of one status lie together, so that a status filter reads only those. The
            # partition column comes last, as Spark reads it back.
            path = self._path(f"{version}/{name}")
            found = tables.settle(with_spread(df))
            base = [*total_order(df, sort_keys()), SortKey(SPREAD)]
            stored = write_rows(found, path, base, STATUS)
            steps = [lambda: write_index(stored, path, _indexed(df.columns))]
            if name == SEARCH:
                # What a search and what a page is read by need the stored rows only.
                steps.append(lambda: write_skip_table(stored, f"{path}/runs", SEARCHED))
            _side_by_side(spark, *steps)
            order = [c for c in found.columns if c != STATUS]
            number = T.StructField(ROW, T.LongType())
            schema = T.StructType([*found.select(*order).schema, number, found.schema[STATUS]])
            return tables.scan(spark, f"{path}/rows", schema)

        searchable, report = _side_by_side(
            spark,
            lambda: stage_classified(
                SEARCH, packages_search(catalogue, lookup, size=size, limits=self.limits)
            ),
            lambda: stage_classified(
                REPORT,
                package_safety_report(catalogue, archive, lookup, size=size, limits=self.limits),
            ),
        )
        frames = (catalogue, archive, flat, lookup, release, searchable, report)
        staged = dict(zip(STAGED, frames, strict=True))
        counts = _row_counts(staged)
        counts[HISTORY] = len(released) + (previous["row_counts"][HISTORY] if previous else 0)
        counts[RUNS] = run_id
        stamp = self._now()
        entry = self._publish(
            run_id,
            {
                "version": version,
                "published_at": stamp,
                "row_counts": counts,
                "schemas": {name: df.schema.json() for name, df in staged.items()},
                "lookup_bytes": size.bytes,
                "released": released,
                "run_id": run_id,
                "refresh_timestamp": stamp,
                "cran_packages_source": source.path(source.packages),
                "cran_archive_source": source.path(source.archive),
                "osv_source_pattern": source.path(source.advisories),
                "status": SUCCESS,
            },
        )
        self.log(message)
        return PublishedVersion(self, entry)

    def _publish(self, run_id: int, record: dict) -> Row:
        """Make a run the current one, unless another has its number: create its record."""
        if not self.commits.add(run_id, record):
            raise PublicationConflict(f"another refresh has published run {run_id}")
        return self.commits.read(run_id)

    def _runs(self, run_id: int) -> DataFrame:
        """The records up to a run."""
        return self.commits.rows().filter(F.col("run_id") <= run_id)

    def _history(self, run_id: int) -> DataFrame:
        """The releases found up to a run."""
        found = self._runs(run_id).select(F.explode("released").alias("release"))
        return found.select("release.*")

    def expire(self, keep: int = 2) -> list[str]:
        """Delete the tables of all but the newest ``keep`` versions; returns what was deleted.

        The current version always stays, and so do the records of all runs. What a refresh is
        writing, or a failed one has left, is no version and is not touched.
        """
        if keep < 1:
            raise ValueError("the current version cannot be deleted")
        stored = [f"versions/{name}" for name in files.names(self.spark, self._path("versions"))]
        published = self.commits.rows().filter(F.col("version").isin(stored))
        newest_first = published.select("version").orderBy(F.desc("run_id")).collect()
        gone = [row["version"] for row in newest_first[keep:]]
        return [name for name in gone if files.delete(self.spark, self._path(name))]

    def _catalogue(self, source: Feeds) -> DataFrame:
        raw = feeds.read_catalogue(
            self.spark, source.path(source.packages), source.catalogue_schema, source.multi_line
        )
        return raw.withColumn(VERSION_KEY, version_key(F.col("Version")))

    def _archive(self, source: Feeds) -> DataFrame:
        raw = feeds.read_archive(
            self.spark, source.path(source.archive), source.archive_schema, source.multi_line
        )
        return parse_archive(raw).withColumn(VERSION_KEY, version_key(F.col("Version")))


def _side_by_side(spark: SparkSession, *steps: Callable) -> list:
    """Results of steps that do not need each other; their Spark jobs may share the executors."""
    with ThreadPoolExecutor(len(steps)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [step.result() for step in started]


def _indexed(columns: Sequence[str]) -> tuple[str, ...]:
    """The columns of a table by which a caller may sort."""
    return tuple(name for name in SORTABLE if name in columns)


def _row_counts(staged: dict[str, DataFrame]) -> dict[str, int]:
    """Rows per table: one job, one row per table."""
    counted = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        for name, df in staged.items()
    ]
    return {row["name"]: row["rows"] for row in reduce(DataFrame.unionByName, counted).collect()}


@dataclass(frozen=True)
class PublishedVersion:
    """One published version. All its queries read the same tables."""

    store: PackageStore
    entry: Row
    _scans: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    @property
    def run_id(self) -> int:
        return self.entry["run_id"]

    @property
    def lookup_size(self) -> Size:
        return Size(self.entry["row_counts"][LOOKUP], self.entry["lookup_bytes"])

    def table(self, name: str) -> DataFrame:
        """A stored table of this version, with its helper columns."""
        if name == HISTORY:
            return self.store._history(self.run_id)
        if name == RUNS:
            return self.store._runs(self.run_id).select(*REFRESH_LOG.names)
        if name in (SEARCH, REPORT):
            return self._indexed(name).rows()
        if name not in self._scans:
            path = self.store._path(f"{self.entry['version']}/{name}")
            self._scans[name] = tables.scan(self.store.spark, path, self._schema(name))
        return self._scans[name]

    def _searched(self, term: str | None) -> DataFrame:
        """The files of the search table that may hold a term."""
        whole = self._indexed(SEARCH)
        files = SkipTable(self.store.spark, f"{whole.path}/runs").files(term)
        if files is None:
            return whole.rows()
        if not files:
            return whole.rows().filter(F.lit(False))
        reader = self.store.spark.read.schema(whole.schema).option("basePath", f"{whole.path}/rows")
        return reader.parquet(*map(unquote, files))

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.entry["schemas"][name]))

    def _indexed(self, name: str) -> IndexedTable:
        path = self.store._path(f"{self.entry['version']}/{name}")
        schema = self._schema(name)
        return IndexedTable(self.store.spark, path, _indexed(schema.names), schema)

    def _page(
        self,
        name: str,
        columns: Sequence[str],
        sort_by: str | None,
        sort_order: str | None,
        limit: int | None,
        offset: int | None,
    ) -> Page:
        """A page of a whole stored table, by its index."""
        found = self._indexed(name)
        limit = DEFAULT_LIMIT if limit is None else limit
        offset = DEFAULT_OFFSET if offset is None else offset
        key = None if sort_by is None else sort_keys(sort_by, sort_order)[0]
        if key is not None and key.column not in found.columns:
            key = SortKey(DEFAULT_ORDER[0], key.descending)
        rows = found.page(key and key.column, bool(key and key.descending), limit, offset)
        return Page(rows.select(*columns), limit, offset, self.entry["row_counts"][name])

    def row_counts(self) -> DataFrame:
        """Rows per published table."""
        own = self.store.commits.rows().filter(F.col("run_id") == self.run_id)
        return own.select(F.explode("row_counts").alias("table_name", "n_rows"))

    def packages_search(self) -> DataFrame:
        """Classified current packages, as stored by the refresh."""
        return self.table(SEARCH).select(*SEARCH_COLUMNS)

    def package_safety_report(self, status: str | None = None) -> DataFrame:
        """Classified current and archived versions, as stored by the refresh."""
        wanted = status_is(STATUS, status)
        stored = self.table(REPORT) if wanted is None else self.table(REPORT).filter(wanted)
        return stored.select(*REPORT_COLUMNS)

    def search_packages(
        self,
        term=None,
        status=None,
        sort_by=None,
        sort_order=None,
        limit=None,
        offset=None,
        format=None,
    ) -> DataFrame | Page:
        unfiltered = not term and wanted_status(status) is None
        if unfiltered and format != NDJSON:
            return self._page(SEARCH, SEARCH_COLUMNS, sort_by, sort_order, limit, offset)
        return search_view(
            self._searched(term).drop(ROW),
            term,
            status,
            sort_by,
            sort_order,
            limit,
            offset,
            format,
            stored=True,
        )

    def report_page(
        self, sort_by=None, sort_order=None, limit=None, offset=None
    ) -> Page:
        """A page of the safety report, sorted as a search is; a column that it lacks is no sort key."""
        return self._page(REPORT, REPORT_COLUMNS, sort_by, sort_order, limit, offset)

    def release_history(self, limit=None, offset=None, format=None) -> DataFrame | Page:
        return records.release_history(self.table(HISTORY), limit, offset, format)

    def refresh_log(self, limit=None, offset=None, format=None) -> DataFrame | Page:
        return records.refresh_log(self.table(RUNS), limit, offset, format)

    def register_views(self) -> None:
        """Make every relation of this version, and the version function, available to SQL."""
        register_version_function(self.store.spark)
        relations = {name: self.table(name) for name in VERSIONED}
        relations[CURRENT] = relations[CURRENT].drop(VERSION_KEY)
        relations[ARCHIVE] = relations[ARCHIVE].drop(VERSION_KEY, "Package", "Version")
        relations[LOOKUP] = relations[LOOKUP].select(
            "Package", "osv_id", "introduced_v", "fixed_v"
        )
        relations[SEARCH] = self.packages_search()
        relations[REPORT] = self.package_safety_report()
        relations[LOG] = self.store.log_table()
        for name, df in relations.items():
            df.createOrReplaceTempView(name)
