"""Document listings: pages of a REST interface as JSON, and object dumps that pages load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import terms
from ..functions import urls as u
from ..operators.ordered import ordered_distinct

#: A fixed value: where the files of object dumps lie.
BLOBS = "https://marketing.webassets.siemens-healthineers.com/"


def page_requests(url: Column, max_results: int = 150) -> Column:
    """The request of each listing page: path and parameters, by name, newest first unless the address says otherwise."""
    pages = -(-max(0, max_results) // terms.LISTING_PAGE_SIZE)
    own = u.listing_params(url)
    base = F.concat(u.scheme(url), F.lit("://"), u.netloc(url), F.lit("/rest/v1/documents?"))
    params = F.when(F.map_contains_key(own, "sort"), own).otherwise(F.map_concat(own, F.create_map(F.lit("sort"), F.lit("-modified-at"))))
    text = F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")
    if not pages:
        return F.expr("cast(array() as array<string>)")
    return F.transform(F.sequence(F.lit(1), F.lit(pages)), lambda n: F.concat(base, text, F.lit("&page="), n.cast("string"), F.lit(f"&pagesize={terms.LISTING_PAGE_SIZE}")))


def records(pages: DataFrame, max_results: int = 150) -> DataFrame:
    """(listing, page_number, at, seq, record) of the first max_results records of stored listing pages (listing, page_number, body), up to the first empty or short page."""
    body = F.try_parse_json("body")
    data = F.try_variant_get(body, "$.data", "array<variant>")
    rows = pages.select("listing", "page_number", F.coalesce(data, F.expr("cast(array() as array<variant>)")).alias("data"))
    w = Window.partitionBy("listing").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.size("data"))
    rows = rows.withColumns({"before": F.coalesce(F.sum("_n").over(w), F.lit(0)), "ended": F.coalesce(F.max((F.col("_n") < terms.LISTING_PAGE_SIZE).cast("int")).over(w), F.lit(0))})
    rows = rows.where("ended = 0").select("listing", "page_number", "before", F.posexplode("data").alias("at", "record"))
    return rows.withColumn("seq", F.col("before") + F.col("at")).where(F.col("seq") < max_results).drop("before")


def documents(pages: DataFrame, max_results: int = 150) -> DataFrame:
    """(listing, seq, id, title, file_format, url, source, state) of each record: state is document, skipped or duplicate.

    Records that aren't objects, whose attributes are no object, that aren't accessible, are blocked or have no id are skipped; missing
    attributes count as none. Of equal addresses the first is a document.
    """
    r = records(pages, max_results)
    get = lambda p, t="string": F.try_variant_get("record", p, t)
    kind = F.schema_of_variant("record")
    attrs = F.try_variant_get("record", "$.attributes", "variant")
    shape = F.when(attrs.isNull(), F.when(kind.contains("attributes:"), "VOID").otherwise("OBJECT<>")).otherwise(F.schema_of_variant(attrs))
    ok = kind.startswith("OBJECT") & shape.startswith("OBJECT") & ~F.coalesce(get("$.attributes.accessible", "boolean") == F.lit(False), F.lit(False)) & ~F.coalesce(get("$.attributes.blockedNotOwner", "boolean"), F.lit(False)) & (F.coalesce(get("$.id"), F.lit("")) != "")
    host = F.concat(u.scheme(F.col("listing")), F.lit("://"), u.netloc(F.col("listing")))
    title = F.coalesce(F.nullif(get("$.attributes.title"), F.lit("")), F.nullif(get("$.attributes.name"), F.lit("")), F.lit(""))
    rows = r.select("listing", "seq", F.coalesce(ok, F.lit(False)).alias("ok"), get("$.id").alias("id"), title.alias("title"), F.upper(F.coalesce(get("$.attributes.fileFormat"), F.lit(""))).alias("file_format"), F.concat(host, F.lit("/download?document-ids="), get("$.id")).alias("url"), F.lit("listing").alias("source"))
    again = F.row_number().over(Window.partitionBy("listing", "ok", "url").orderBy("seq")) > 1
    return rows.withColumn("state", F.when(~F.col("ok"), "skipped").when(again, "duplicate").otherwise("document")).drop("ok")


def listing_counts(found: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return found.groupBy("listing").agg(F.count("*").alias("records_scanned"), n("document").alias("documents_discovered"), (n("skipped") + n("duplicate")).alias("skipped_or_deduplicated_documents"), F.count_if((F.col("state") == "document") & (F.col("file_format") == "PDF")).alias("pdfs"))


def dump_scripts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, page_url, pos, url) of the scripts of pages that hold object dumps."""
    tags = F.regexp_extract_all("html", F.lit(r"""(?is)<script\b[^>]*?\bsrc\s*=\s*["']([^"']*preloadDumps[^"']*)["']"""), F.lit(1))
    rows = pages.select(F.col(key).alias("page_id"), F.col("url").alias("page_url"), F.posexplode(tags).alias("pos", "href"))
    rows = rows.withColumn("url", u.urljoin("page_url", F.trim("href")))
    return ordered_distinct(rows, ["page_id", "url"], ["pos"]).drop("href")


def parse_dump(script: Column) -> Column:
    """The dump of a script as a VARIANT: JSON inside a JSON string."""
    inner = F.regexp_extract(script, r"(?s)window\.preloadDump = (.*);\s*$", 1)
    return F.try_parse_json(F.try_variant_get(F.try_parse_json(inner), "$", "string"))


def dump_pdfs(dumps: DataFrame) -> DataFrame:
    """(page_id, pos, url) of the PDF files of download items below each page's path, from scripts (page_id, page_url, body): items joined with the objects they link to. Of objects of one id the last counts."""
    rows = dumps.select("page_id", "page_url", F.posexplode(F.try_variant_get(parse_dump(F.col("body")), "$.recording", "array<variant>")).alias("pos", "entry"))
    rows = rows.where(F.try_variant_get("entry", "$[0]", "string") == "baseobj").select("page_id", "page_url", "pos", F.try_variant_get("entry", "$[1][1]", "string").alias("obj"), F.try_variant_get("entry", "$[2]", "variant").alias("o"))
    objs = rows.groupBy("page_id", "page_url", "obj").agg(F.max_by(F.to_json("o"), "pos").alias("json"), F.min("pos").alias("pos")).withColumn("o", F.parse_json("json"))
    get = lambda p: F.try_variant_get("o", p, "string")
    either = lambda p, q: F.coalesce(get(p), get(q))  # noqa: E731  a value may be wrapped as [type, value]
    top = F.regexp_replace(u.path(F.col("page_url")), "/+$", "")
    items = objs.where((get("$._obj_class") == "DownloadItem") & ((top == "") | F.coalesce(get("$._path"), F.lit("")).contains(F.concat(top, F.lit("/")))))
    items = items.select("page_id", "pos", either("$.link[1].obj_id", "$.link.obj_id").alias("obj"))
    blobs = objs.select("page_id", "obj", either("$.blob[1].id", "$.blob.id").alias("blob")).where(F.lower("blob").endswith(".pdf"))
    found = items.join(blobs, ["page_id", "obj"]).select("page_id", "pos", F.concat(F.lit(BLOBS), "blob").alias("url"))
    return ordered_distinct(found, ["page_id", "url"], ["pos"])
