"""Pages over HTTP as a data source: one partition for each share of the addresses, errors as rows.

    spark.dataSource.register(WebPages)
    spark.read.format("web_pages").option("urls", "\\n".join(urls)).load()

Stored pages (Parquet with page_id, url, html) go through read_pages, so the engine runs the same with or without a network. A page that needs a
browser, a login or a click is outside of this source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import quality, urls
from . import html

SCHEMA = "seq long, url string, html string, content_type string, success boolean, error string"
AGENT = "docharbor"
#: A binary file that is larger isn't read.
MAX_BYTES = 5 << 20


class _Share(InputPartition):
    def __init__(self, rows: list[tuple[int, str]]):
        super().__init__(0)
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.n = max(1, int(options.get("concurrency", "3")))
        self.timeout = float(options.get("timeout", "30"))
        self.headers = {k[7:]: v for k, v in options.items() if k.startswith("header.")}

    def partitions(self):
        rows = list(enumerate(self.urls))
        return [_Share(rows[i :: self.n]) for i in range(min(self.n, len(rows)))] or [_Share([])]

    def read(self, partition):
        from urllib.request import Request, urlopen

        for seq, url in partition.rows:
            try:
                with urlopen(Request(url, headers={"User-Agent": AGENT, **self.headers}), timeout=self.timeout) as r:
                    kind = r.headers.get("Content-Type") or ""
                    body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                yield seq, url, body, kind, True, None
            except Exception as e:  # a failed page is a row
                yield seq, url, None, None, False, str(e)


class WebPages(DataSource):
    @classmethod
    def name(cls):
        return "web_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def fetch(spark: SparkSession, addresses: list[str], concurrency: int = 3, timeout: int = 30, headers: dict[str, str] | None = None) -> DataFrame:
    """A row for each address, in order of seq; a scheme is put before addresses without one. Headers carry tokens and cookies."""
    spark.dataSource.register(WebPages)
    fixed = ["https://" + a.strip() if not a.strip().startswith("http") else a.strip() for a in addresses]
    reader = spark.read.format("web_pages").option("urls", "\n".join(fixed)).option("concurrency", str(concurrency)).option("timeout", str(timeout))
    for k, v in (headers or {}).items():
        reader = reader.option(f"header.{k}", v)
    return reader.load()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumns({"success": F.col("html").isNotNull(), "error": F.when(F.col("html").isNull(), "no content")})


def read_jdbc(spark: SparkSession, query: str, env: dict[str, str]) -> DataFrame:
    """A query of a database; the address comes from DOCHARBOR_DB_HOST, _PORT, _NAME, _USER and _PASSWORD, the password without a default."""
    host, port, name = (env.get(f"DOCHARBOR_DB_{k}", v) for k, v in (("HOST", "localhost"), ("PORT", "5432"), ("NAME", "docharbor")))
    return spark.read.format("jdbc").option("url", f"jdbc:postgresql://{host}:{port}/{name}").option("user", env.get("DOCHARBOR_DB_USER", "docharbor")).option("password", env["DOCHARBOR_DB_PASSWORD"]).option("query", query).load()


def images(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Image files below a path up to a size: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where((F.col("length") <= max_bytes) & F.lower("path").rlike(r"\.(jpe?g|png|gif|webp|svg|tiff?|bmp)$"))


def page_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Stored pages as page results: title, markdown, links (web addresses, ordered distinct), quality verdict, retry candidates."""
    from ..operators import links as ln

    texts = html.page_texts(pages, key=key)
    found = ln.dedupe_links(html.links(pages, key=key).where("kind = 'a'"))
    links = found.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("links"))
    rows = pages.select(F.col(key).alias("page_id"), "url", quality.block_signals(F.col("html")).alias("block_signals"), F.col("html").isNotNull().alias("success")).join(texts.drop("page_url"), "page_id").join(links, "page_id", "left")
    rows = rows.withColumn("links", F.coalesce("links", F.expr("cast(array() as array<string>)")))
    verdict = quality.source_quality(F.col("title"), F.col("markdown"), F.col("links"), F.col("block_signals"))
    return rows.withColumn("verdict", verdict).select("page_id", "url", "title", "markdown", "links", "block_signals", "success", "verdict.*", F.slice(urls.retry_candidates(F.col("url"), F.col("links")), 1, 3).alias("retry_candidates"))


def substitute_bad(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """pages (page_rows), each bad one replaced by its first candidate page (page_rows of other addresses) that is good."""
    tries = pages.where("source_quality = 'bad_source_page'").select("page_id", F.posexplode("retry_candidates").alias("rank", "url"))
    good = candidates.where("source_quality = 'good'").select(F.col("url"), F.struct(*[c for c in pages.columns if c != "page_id"]).alias("new"))
    best = tries.join(good, "url").groupBy("page_id").agg(F.min_by("new", "rank").alias("new"))
    cols = [c for c in pages.columns if c != "page_id"]
    return pages.join(best, "page_id", "left").select("page_id", *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in cols])
