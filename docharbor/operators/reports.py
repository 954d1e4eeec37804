"""What a user is shown of a crawl, a discovery or a workflow: rows and totals, all as grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from . import blocks, gazette, graph
from . import links as ln
from .lineage import cut
from .ordered import ordered_distinct

#: What a discovery crawl looks for, and what a download that met a web page says.
DISCOVERY_PATTERNS = ("*[Dd]ocument*", "*[Pp]ublication*", "*[Dd]ownload*", "*[Ff]ile*", "*[Rr]ecueil*", "*[Aa]rrete*")
HTML_INSTEAD = "returned HTML instead of a downloadable file"


def downloads_by_region(selected: DataFrame, downloads: DataFrame) -> DataFrame:
    """selected (seq, region) side by side with downloads (seq, status): how many of each region were selected, downloaded and failed."""
    region = F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown-region")).alias("region")
    status = F.coalesce("status", F.lit(""))
    both = selected.select("seq", region).join(downloads.select("seq", "status"), "seq")
    return both.groupBy("region").agg(F.count("*").alias("selected"), F.count_if(status == "downloaded").alias("downloaded"), F.count_if(status.startswith("failed:")).alias("failed"))


def blocked_downloads(downloads: DataFrame, message: str = HTML_INSTEAD) -> DataFrame:
    """One row: how many downloads have the message in their status."""
    return downloads.agg(F.count_if(F.col("status").contains(message)).alias("blocked"))


def region_totals(regions: DataFrame) -> DataFrame:
    """regions (region, documents_url, entries): one row with the number of resolved documents pages and of entry pages."""
    return regions.agg(F.count_if(F.coalesce("documents_url", F.lit("")) != "").alias("documents_pages_resolved"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).cast("long").alias("raa_entry_count"))


def block_rows(found: DataFrame) -> DataFrame:
    """Structured blocks (sources.html.page_blocks) as rows of a sheet, with their first five links."""
    return found.select("page_id", "pos", F.col("block_id").alias("Block ID"), F.col("block_type").alias("Type"), F.col("heading").alias("Heading"), F.col("text").alias("Text"), F.array_join(F.slice("links", 1, 5), ", ").alias("Links"))


def preview(col, most: int = 300):
    return F.trim(F.replace(F.substring(col, 1, most), F.lit("\n"), F.lit(" ")))


def page_rows(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, url, title, success, markdown, links) with sizes of the text before and after cleaning, the number of links, and previews."""
    clean = blocks.page_results(pages, keys, "markdown", "url", "title").select(*keys, "clean_text")
    rows = pages.join(clean, keys)
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return rows.select(*keys, "url", "title", "success", size("markdown").alias("content_chars"), size("clean_text").alias("clean_content_chars"), F.coalesce(F.size("links"), F.lit(0)).alias("links_found"), preview(F.coalesce("markdown", F.lit(""))).alias("content_preview"), preview("clean_text").alias("clean_preview"))


def crawl_totals(rows: DataFrame) -> DataFrame:
    """One row for page_rows: pages, characters, characters after cleaning."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("total_pages"), total("content_chars").alias("total_chars"), total("clean_content_chars").alias("total_clean_chars"))


def discover_files(pages: DataFrame, links: DataFrame, start_url: str, max_depth: int = 3, max_pages: int = 20, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, scanned pages) of a crawl of stored pages (page_id, url, title, success) along links (page_id, page_url, pos, href, url) that looks for files.

    documents (seq, url, title, file_format, source): files of the start page, then of the relevant pages in the crawl's order, each address
    once. scanned (seq, url, title, files_found, pdf_links_found): the start page, and each relevant page.
    """
    start, _ = ln._normal(start_url)
    hops = ln.absolute(links).select(F.col("page_url").alias("src"), "pos", F.col("url").alias("dst"))
    crawled = graph.crawl_focused(pages, hops, start_url, include=DISCOVERY_PATTERNS, max_depth=max_depth, max_pages=max_pages, robots=robots)
    scanned = crawled.where((F.col("seq") == 0) | ln.relevant_page(F.col("url"), F.lit(start)))
    scanned = cut(scanned.join(pages.select(u.normalize(F.col("url")).alias("url"), "page_id", "title"), "url"), "scanned")
    files = ln.file_links(links.join(scanned.select("page_id", "seq"), "page_id"))
    once = ordered_distinct(files.select("url", F.struct("seq", "pos").alias("at")), ["url"], ["at"])
    name = F.regexp_extract(F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "/+$", ""), "([^/]*)$", 1)
    documents = once.select("at", "url", name.alias("title"), F.upper(F.regexp_replace(u.extension(F.col("url")), r"^\.", "")).alias("file_format"), F.lit("crawl_file_link").alias("source"))
    found = files.groupBy("seq").agg(F.count("*").alias("files_found"), F.count_if(F.lower("url").contains(".pdf")).alias("pdf_links_found"))
    scanned = scanned.select("seq", "url", "title").join(found, "seq", "left").fillna(0, ["files_found", "pdf_links_found"])
    return documents, scanned


def run_workflow(start_url: str, pages: DataFrame, download: Callable[[DataFrame], DataFrame], order: list[str], days: int | None = None, most: int | None = None, today: date | None = None, exclude_regions: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(downloads, one row of counters): documents of stored gazette pages are discovered, selected and downloaded.

    download gets the selected documents with seq, their place by order, and gives a status row (seq, status) for each. Both steps are written before they are
    read again, so nothing is fetched twice.
    """
    from .ordered import numbered

    documents, _ = gazette.discover(start_url, pages, days=days, today=today, exclude_regions=exclude_regions)
    documents = cut(documents, "workflow-documents")
    chosen, counts = gazette.select_documents(documents, order, days, most)
    chosen = cut(numbered(chosen, order, "seq"), "workflow-selected")
    done = cut(download(chosen), "workflow-downloads")
    good = F.count_if(F.col("status") == "downloaded")
    sums = done.agg(F.count("*").alias("pdfs_attempted"), good.alias("pdfs_downloaded_successfully"), F.count_if(F.col("status").startswith("failed")).alias("failed_downloads"))
    found = documents.agg(F.count("*").alias("pdfs_discovered"), F.countDistinct("region").alias("regions_with_documents"))
    return done, counts.crossJoin(sums).crossJoin(found)  # one row each
