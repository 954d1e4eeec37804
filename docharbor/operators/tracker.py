"""The inventory of documents seen so far: new ones by anti-join, upserts as joins, summaries, runs and downloads.

Tables are Parquet folders with a version for each change, and the largest complete version counts: a table is never overwritten while it is
read, and a failed write leaves the old version in place. A repository has one writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms
from ..functions import dates as d
from ..functions import urls as u
from .lineage import cut
from .ordered import numbered, ordered_distinct

RUNS = "id long, run_type string, started_at timestamp, finished_at timestamp, status string, regions_scanned int, months_scanned string, pdfs_discovered int, new_pdfs int, downloaded int, failed int, discovery_seconds double, db_seconds double, download_seconds double, excel_seconds double, total_seconds double, error string"
DOCUMENTS = "id long, normalized_url string, pdf_url string, region string, year string, month string, publication_date date, date_source string, source_page string, title string, first_seen_at timestamp, last_seen_at timestamp, first_run_id long, last_run_id long"
DOWNLOADS = "id long, run_id long, document_id long, attempted_at timestamp, status string, saved_path string, error string"
TIMES = ("discovery_seconds", "db_seconds", "download_seconds", "excel_seconds", "total_seconds")
#: A fixed value that runs record; it isn't measured.
REGIONS = 12


def key(url: str = "url") -> Column:
    return u.normalize(F.coalesce(F.col(url), F.lit("")))


def in_region(region: Column, excluded: Iterable[str]) -> Column:
    return ~F.lower(F.coalesce(region, F.lit(""))).isin([str(r).lower() for r in excluded] or [""])


def daily_documents(documents: DataFrame, scope: list[tuple[str, int, str]], order: list[str], excluded: Iterable[str] = terms.DAILY_EXCLUDED_REGIONS) -> DataFrame:
    """Documents of the months, the first of each address among those; some regions are left out."""
    fits = d.in_months(F.col("publication_date"), F.col("year"), F.col("month"), scope)
    rows = documents.where(in_region(F.col("region"), excluded) & fits).withColumn("normalized_url", key())
    return ordered_distinct(rows, ["normalized_url"], order)


def archive_documents(documents: DataFrame, order: list[str], excluded: Iterable[str] = terms.DAILY_EXCLUDED_REGIONS) -> DataFrame:
    return ordered_distinct(documents.where(in_region(F.col("region"), excluded)).withColumn("normalized_url", key()), ["normalized_url"], order)


def known(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    return documents.join(inventory.select("normalized_url"), "normalized_url", "left_semi")


def unknown(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    return documents.join(inventory.select("normalized_url"), "normalized_url", "left_anti")


def upsert(inventory: DataFrame, documents: DataFrame, run_id: int, seen_at: Column, order: list[str]) -> DataFrame:
    """inventory (DOCUMENTS) after documents were seen in a run.

    New addresses are inserted with ids after the largest. Of known ones the last sighting, page and title follow the latest row; a date is
    filled in where there was none, a date's source where it was blank; region, year, month, address and first sighting never change. Several
    rows of one address count in their order, the first as the insert.
    """
    rows = documents.withColumn("normalized_url", key()).withColumns({"_d": F.try_to_date(F.nullif("publication_date", F.lit("")), "yyyy-MM-dd"), "_o": F.struct(*order)})
    src = F.nullif(F.coalesce("date_source", F.lit("")), F.lit(""))
    batch = rows.groupBy("normalized_url").agg(
        F.min_by(F.struct(F.coalesce("url", F.lit("")).alias("pdf_url"), F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown-region")).alias("region"), F.coalesce("year", F.lit("")).alias("year"), F.coalesce("month", F.lit("")).alias("month")), "_o").alias("n_first"),
        F.max_by(F.struct(F.coalesce("source_page", F.lit("")).alias("page"), F.coalesce("title", F.lit("")).alias("title")), "_o").alias("n_last"),
        F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col("_o"))).alias("n_date"),
        F.min_by(src, F.when(src.isNotNull(), F.col("_o"))).alias("n_source"),
        F.min("_o").alias("_o"),
    )
    old = inventory.withColumn("_old", F.lit(True))
    all_ = old.join(batch, "normalized_url", "full_outer")
    is_old, seen = F.coalesce("_old", F.lit(False)), F.col("n_first").isNotNull()
    keep = lambda c, new: F.when(is_old, F.col(c)).otherwise(new).alias(c)
    fresh = lambda c, new: F.when(seen, new).otherwise(F.col(c)).alias(c)
    base = all_.select(
        "id",
        "normalized_url",
        keep("pdf_url", F.col("n_first.pdf_url")),
        keep("region", F.col("n_first.region")),
        keep("year", F.col("n_first.year")),
        keep("month", F.col("n_first.month")),
        F.coalesce("publication_date", "n_date").alias("publication_date"),
        F.when(seen, F.coalesce(F.nullif("date_source", F.lit("")), "n_source", F.lit(""))).otherwise(F.col("date_source")).alias("date_source"),
        fresh("source_page", F.col("n_last.page")),
        fresh("title", F.col("n_last.title")),
        keep("first_seen_at", seen_at),
        fresh("last_seen_at", seen_at),
        keep("first_run_id", F.lit(run_id).cast("long")),
        fresh("last_run_id", F.lit(run_id).cast("long")),
        "_o",
        is_old.alias("_was"),
    )
    largest = inventory.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    new = numbered(base.where("not _was"), ["_o", "normalized_url"], "_r").crossJoin(F.broadcast(largest)).withColumn("id", (F.col("m") + F.col("_r")).cast("long"))
    cols = [c.split()[0] for c in DOCUMENTS.split(", ")]
    return base.where("_was").select(*cols).unionByName(new.select(*cols))


def _joined(col: str, down: bool) -> Column:
    return F.array_join(F.sort_array(F.collect_set(F.nullif(col, F.lit(""))), not down), ", ")


def summarize_new(documents: DataFrame) -> DataFrame:
    region = F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown-region")).alias("region")
    return documents.groupBy(region).agg(F.count("*").alias("new_pdfs"), _joined("year", True).alias("years"), _joined("month", False).alias("months")).orderBy(F.desc("new_pdfs"), "region")


def summarize_scope(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """documents (with normalized_url) by region: how many, how many known, how many new."""
    flag = documents.join(inventory.select("normalized_url").distinct().withColumn("_known", F.lit(True)), "normalized_url", "left")
    region = F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown-region")).alias("region")
    n_known = F.count_if(F.coalesce("_known", F.lit(False)))
    return flag.groupBy(region).agg(F.count("*").alias("daily_scoped_pdfs"), n_known.alias("already_known"), (F.count("*") - n_known).alias("new_pdfs"), _joined("year", True).alias("years"), _joined("month", False).alias("months")).orderBy("region")


def summarize_downloads(downloads: DataFrame) -> DataFrame:
    good = F.count_if(F.col("status") == "downloaded")
    return downloads.agg(F.count("*").alias("download_attempts"), good.alias("documents_downloaded_successfully"), (F.count("*") - good).alias("failed_downloads"))


def inventory_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("region", "year", "month").agg(F.count("*").alias("documents")).orderBy(F.asc_nulls_last("region"), F.desc_nulls_last("year"), F.asc_nulls_last("month"))


class Repository:
    """Runs, documents and downloads as versioned tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, table: str) -> list[str]:
        fs, path = self._fs()
        top = path(f"{self.root}/{table}")
        if not fs.exists(top):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(top) if fs.exists(path(s.getPath(), "_SUCCESS")))

    def read(self, table: str, schema: str) -> DataFrame:
        found = self._versions(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def replace(self, table: str, df: DataFrame) -> None:
        """A new version, which counts once it is complete; older ones but the last are deleted."""
        old = self._versions(table)
        n = int(old[-1].split("-")[0][1:]) + 1 if old else 1
        df.write.parquet(f"{self.root}/{table}/v{n:08d}-{uuid.uuid4().hex[:8]}")
        fs, path = self._fs()
        for v in old[:-1]:
            fs.delete(path(f"{self.root}/{table}/{v}"), True)

    def runs(self) -> DataFrame:
        return self.read("runs", RUNS)

    def documents(self) -> DataFrame:
        return self.read("documents", DOCUMENTS)

    def downloads(self) -> DataFrame:
        return self.read("downloads", DOWNLOADS)

    def has_baseline(self) -> bool:
        return not self.runs().where("run_type = 'archive_baseline' and status = 'baseline_created'").isEmpty()

    def create_run(self, started_at: datetime, months: str, run_type: str = "daily_diff") -> int:
        runs = self.runs()
        run_id = (runs.agg(F.max("id")).first()[0] or 0) + 1
        row = (run_id, run_type, started_at, None, "running", REGIONS, months, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
        self.replace("runs", runs.unionByName(self.spark.createDataFrame([row], RUNS)))
        return run_id

    def change_run(self, run_id: int, values: dict[str, Column]) -> None:
        runs = self.runs()
        self.replace("runs", runs.withColumns({c: F.when(F.col("id") == run_id, v).otherwise(F.col(c)).cast(runs.schema[c].dataType) for c, v in values.items()}))

    def finish_run(self, run_id: int, status: str, counts: dict[str, int] | None = None, times: dict[str, float] | None = None, error: str = "") -> None:
        values = {"finished_at": F.lit(datetime.now(UTC)), "status": F.lit(status), "error": F.lit(error)}
        values |= {c: F.lit(int((counts or {}).get(c, 0))) for c in ("pdfs_discovered", "new_pdfs", "downloaded", "failed")}
        self.change_run(run_id, values | {c: F.lit(float((times or {}).get(c, 0))) for c in TIMES})

    def add_downloads(self, run_id: int, downloaded: int, failed: int, times: dict[str, float] | None = None) -> None:
        values = {"downloaded": F.lit(downloaded), "failed": F.lit(failed)}
        self.change_run(run_id, values | {c: F.coalesce(F.col(c), F.lit(0.0)) + float((times or {}).get(c, 0)) for c in TIMES[1:]})

    def upsert(self, documents: DataFrame, run_id: int, seen_at: datetime, order: list[str]) -> None:
        self.replace("documents", upsert(self.documents(), documents, run_id, F.lit(seen_at).cast("timestamp"), order))

    def record_downloads(self, run_id: int, documents: DataFrame, downloads: DataFrame) -> None:
        """A row for each pair of documents and downloads with the same seq."""
        failed = F.when(F.col("status").startswith("failed:"), F.col("status")).otherwise("")
        rows = documents.select("seq", key().alias("normalized_url")).join(downloads.select("seq", "status", "file_path"), "seq").join(self.documents().select(F.col("id").alias("document_id"), "normalized_url"), "normalized_url", "left")
        old = self.downloads()
        top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
        rows = numbered(rows, ["seq"], "_r").crossJoin(F.broadcast(top))
        rows = rows.select((F.col("m") + F.col("_r")).cast("long").alias("id"), F.lit(run_id).cast("long").alias("run_id"), "document_id", F.lit(datetime.now(UTC)).cast("timestamp").alias("attempted_at"), "status", F.col("file_path").alias("saved_path"), failed.alias("error"))
        self.replace("downloads", old.unionByName(rows))

    def daily_runs(self) -> DataFrame:
        return self.runs().orderBy(F.desc("started_at"))

    def inventory(self) -> DataFrame:
        return self.documents().orderBy("region", F.desc_nulls_first("year"), F.asc_nulls_last("title"))

    def download_log(self) -> DataFrame:
        return self.downloads().orderBy(F.desc("attempted_at"))

    def new_documents(self, run_id: int) -> DataFrame:
        rows = self.documents().where(F.col("first_run_id") == run_id)
        return rows.select(F.col("pdf_url").alias("url"), "region", "year", "month", F.col("publication_date").cast("string").alias("publication_date"), "date_source", "source_page", "title", F.lit("PDF").alias("file_format")).orderBy("region", F.asc_nulls_last("publication_date"), "title")


def report(repo: Repository, folder: str, new_documents: DataFrame, downloads: DataFrame) -> str:
    """Four tables as CSV below folder: daily_runs, new_documents, downloads, inventory_snapshot; times without zone, in UTC."""
    sheets = {"daily_runs": repo.daily_runs(), "new_documents": new_documents, "downloads": downloads, "inventory_snapshot": repo.inventory()}
    for name, df in sheets.items():
        plain = [F.col(f.name).cast("timestamp_ntz").cast("string").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema]
        df.select(*plain).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    return folder


def _since(t: float) -> float:
    return round(time.perf_counter() - t, 2)


def create_baseline(repo: Repository, discover: Callable[..., DataFrame], order: list[str], folder: str | None = None) -> dict:
    """The first run: everything found is inventory, nothing is new."""
    began = time.perf_counter()
    now = datetime.now(UTC)
    run_id = repo.create_run(now, "archive-all", "archive_baseline")
    try:
        t = time.perf_counter()
        docs = cut(archive_documents(discover(years=None, months=None), order), "discovered")
        times = {"discovery_seconds": _since(t)}
        t = time.perf_counter()
        repo.upsert(docs, run_id, now, order)
        n = repo.documents().where(F.col("last_run_id") == run_id).count()
        times["db_seconds"] = _since(t)
        if folder:
            report(repo, folder, repo.new_documents(-1), repo.downloads().limit(0))
        repo.finish_run(run_id, "baseline_created", {"pdfs_discovered": n}, times | {"total_seconds": _since(began)})
        return {"run_id": run_id, "status": "baseline_created", "baseline_exists": False, "pdfs_discovered": n, "already_known": 0, "new_pdfs": 0}
    except Exception as e:
        repo.finish_run(run_id, "failed", error=str(e))
        raise


def daily_check(repo: Repository, discover: Callable[..., DataFrame], order: list[str], today: date | None = None, folder: str | None = None) -> dict:
    """A daily run: the month's documents against the inventory, then into it. Without a baseline that is made instead.

    discover(years, months) gives documents. New means first sighted: documents are in the inventory before any download.
    """
    if not repo.has_baseline():
        return create_baseline(repo, discover, order, folder)
    began = time.perf_counter()
    today, now = today or date.today(), datetime.now(UTC)
    scope = d.current_months(today)
    months = ", ".join(s[2] for s in scope)
    run_id = repo.create_run(now, months)
    try:
        t = time.perf_counter()
        docs = cut(daily_documents(discover(years=[str(today.year)], months=[s[0] for s in scope]), scope, order), "discovered")  # a live source may say something else the next time
        times = {"discovery_seconds": _since(t)}
        t = time.perf_counter()
        by_region = summarize_scope(docs, repo.documents()).collect()  # a row a region
        repo.upsert(docs, run_id, now, order)
        times["db_seconds"] = _since(t)
        new = repo.new_documents(run_id)
        total, fresh = sum(r.daily_scoped_pdfs for r in by_region), sum(r.new_pdfs for r in by_region)
        if folder:
            report(repo, folder, new, repo.downloads().limit(0))
        repo.finish_run(run_id, "completed", {"pdfs_discovered": total, "new_pdfs": fresh}, times | {"total_seconds": _since(began)})
        return {"run_id": run_id, "status": "completed", "baseline_exists": True, "months_scanned": months, "pdfs_discovered": total, "already_known": total - fresh, "new_pdfs": fresh, "daily_by_region": by_region, "new_documents": new, "new_by_region": summarize_new(new)}
    except Exception as e:
        repo.finish_run(run_id, "failed", error=str(e))
        raise


def download_new(repo: Repository, run_id: int, download: Callable[[DataFrame], DataFrame], documents: DataFrame | None = None, folder: str | None = None) -> dict:
    """Downloads a run's new documents, or those given (with seq); download returns a status row (seq, status, file_path, ...) for each. Counts and times are added to the run."""
    began = time.perf_counter()
    docs = documents if documents is not None else numbered(repo.new_documents(run_id), ["region", F.asc_nulls_last("publication_date"), "title", "url"], "seq")
    repo.upsert(docs, run_id, datetime.now(UTC), ["seq"])
    t = time.perf_counter()
    done = cut(download(docs), "downloads")  # written once: a file is fetched once, however often its row is read
    times = {"download_seconds": _since(t)}
    repo.record_downloads(run_id, docs, done)
    s = summarize_downloads(done).first()
    if folder:
        report(repo, folder, docs, done)
    repo.add_downloads(run_id, s.documents_downloaded_successfully, s.failed_downloads, times | {"total_seconds": _since(began)})
    return {"run_id": run_id, "downloaded": s.documents_downloaded_successfully, "failed": s.failed_downloads}
