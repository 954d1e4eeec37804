"""Gazettes of regional prefectures: which links lead to them, which pages list them, what their documents are."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..functions import dates as d
from ..functions import text as tx
from ..functions import urls as u
from . import links as ln
from .ordered import cap_per_group, first_unless_upgraded, locf, ordered_distinct


def path_text(url: Column) -> Column:
    both = u.unquote(F.concat(u.path(url), F.lit(" "), u.query(url)))
    return tx.norm_text(F.translate(both, "/-_+", "    "))


def combined(url: Column, text: Column | str = "") -> Column:
    """Link text and address as one normalised text."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.trim(F.concat(tx.norm_text(text), F.lit(" "), path_text(url)))


def government_host(url: Column) -> Column:
    return u.host_in(url, ["gouv.fr"])


def portal_host(url: Column) -> Column:
    return u.netloc(url).isin(*terms.PORTAL_HOSTS)


def html_page(url: Column) -> Column:
    """A web address that is neither a file nor a service page."""
    p = u.low_path(url)
    ends = F.lit(False)
    for e in terms.NON_HTML:
        ends = ends | p.endswith(e)
    return ~ends & ~tx.any_of(p, terms.PATH_NOISE) & u.scheme(url).isin("http", "https")


def region_slug(url: Column, portal: str = terms.PORTAL) -> Column:
    return F.when(u.same_host(url, F.lit(portal)), F.lower(F.coalesce(F.get(u.segments(url), F.lit(0)), F.lit("")))).otherwise("")


def region_page(url: Column, portal: str = terms.PORTAL) -> Column:
    return u.same_host(url, F.lit(portal)) & (u.depth(url) == 1) & ~region_slug(url, portal).isin(*terms.REGION_EXCLUDED)


def documents_page(url: Column) -> Column:
    t, p = path_text(url), u.low_path(url)
    return t.contains("documents publications") | p.contains("documents-publications") | (p.contains("tags/view") & t.contains("documents et publications"))


def has_context(url: Column, text: Column | str = "") -> Column:
    """Address or text names the gazette, or has the word raa beside publications or records."""
    p = u.low_path(url)

    def names(t):
        word = F.array_contains(F.split(F.replace(t, F.lit("."), F.lit(" ")), " +"), "raa")
        near = t.contains("documents publications") | p.contains("/documents-publications") | t.contains("recueil") | t.contains("actes administratifs")
        return tx.any_of(t, terms.GAZETTE_TEXT) | (word & near)

    return tx.any_of(p, terms.GAZETTE_PATH) | tx.let(combined(url, text), names)


def pagination(url: Column, text: Column | str = "") -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return u.low_path(url).contains("/(offset)/") | tx.let(tx.norm_text(text), lambda t: tx.any_of(t, terms.PAGINATION))


def year_or_month(url: Column, text: Column | str = "") -> Column:
    return tx.let(combined(url, text), d.names_year_or_month)


def in_scope(url: Column, text: Column | str = "", years: Iterable[str] | None = None, months: Iterable[str] | None = None) -> Column:
    return d.in_scope(combined(url, text), years, months)


def same_region(url: Column, slug: Column) -> Column:
    return (slug != "") & u.low_path(url).startswith(F.concat(F.lit("/"), slug, F.lit("/")))


def trusted_candidate(url: Column, text: Column, source: Column, source_is_branch: Column) -> Column:
    """Another government host's page of gazettes, found on a page of gazettes."""
    return ~u.same_host(url, source) & government_host(url) & ~u.host_in(url, terms.BLOCKED_HOSTS) & html_page(url) & (source_is_branch | has_context(source)) & has_context(url, text)


def above_root(url: Column, roots: Column) -> Column:
    """Whether a root lies at or below url: an address counts as within a branch if it is an ancestor of its root."""
    return F.exists(roots, lambda r: u.same_family(r, url, hosts=True))


def from_branch(source: Column, branch: Column, roots: Column) -> Column:
    return (u.normalize(source) == u.normalize(branch)) | has_context(source) | above_root(source, roots)


def registers_root(url: Column, text: Column, source: Column, branch: Column, roots: Column) -> Column:
    """Whether a link becomes a trusted root of its own."""
    own = trusted_candidate(url, text, source, from_branch(source, branch, roots)) | (above_root(source, roots) & u.same_host(url, source) & has_context(url, text))
    return ~u.same_host(url, branch) & ~above_root(url, roots) & own


def follows(url: Column, text: Column, slug: Column, branch: Column, source: Column, roots: Column, years=None, months=None) -> Column:
    """Whether a traversal of gazette pages goes from source to url; the first rule that applies decides."""
    ctx, dated, paged, p = has_context(url, text), year_or_month(url, text), pagination(url, text), u.low_path(url)
    family, home = u.same_family(branch, url, hosts=True), u.same_host(url, branch)
    listed = p.contains("/documents-publications/")
    other = F.when(family, ctx | dated | paged).otherwise(ctx & (dated | paged))
    own = F.when((slug != "") & ~same_region(url, slug), False).when(~listed & ~p.contains("/tags/view/"), False).when(has_context(url), True).when(family, dated | paged).when(listed & ctx, dated).otherwise(False)
    return (
        F.when(~html_page(url) | ~in_scope(url, text, years, months), False)
        .when(trusted_candidate(url, text, source, from_branch(source, branch, roots)), True)
        .when(home & ~portal_host(branch), other)
        .when(home, own)
        .when(above_root(url, roots), ctx | dated | paged)
        .when(above_root(source, roots) & u.same_host(url, source), ctx)
        .otherwise(False)
    )


# Discovery over stored pages: links (page_url, pos, url, text) as operators.links.page_links gives them, page_url normalised.


def region_pages(links: DataFrame, portal: str = terms.PORTAL) -> DataFrame:
    return links.where((F.col("page_url") == u.normalize(F.lit(portal))) & region_page(F.col("url"), portal)).select("pos", "url")


def documents_candidates(region_url: Column) -> Column:
    base = u.normalize(region_url)
    p = F.regexp_replace(u.path(base), "/+$", "")
    made = F.transform(F.array(F.lit("Documents-publications"), F.lit("DOCUMENTS-PUBLICATIONS")), lambda s: u.build(u.scheme(base), u.netloc(base), F.concat(p, F.lit("/"), s), F.lit("")))
    return F.when(p != "", made).otherwise(F.expr("cast(array() as array<string>)"))


def documents_pages(regions: DataFrame, links: DataFrame) -> DataFrame:
    """regions (region_url) with documents_url: the region itself if it is such a page, else its best link, else the usual address."""
    l = links.select(u.normalize(F.col("page_url")).alias("region_url"), "url", "text")
    r = F.col("region_url")
    p, t, slug = u.low_path(F.col("url")), tx.norm_text(F.col("text")), region_slug(r)
    named = t.contains("documents publications")
    score = F.when(p.contains("documents-publications"), 100).otherwise(0) + F.when(p.rlike("/documents-publications/?$"), 50).otherwise(0) + F.when(named, 20).otherwise(0) - F.when(p.contains("/tags/view/"), 25).otherwise(0)
    cand = l.where(u.same_host(F.col("url"), r) & ((slug == "") | same_region(F.col("url"), slug)) & html_page(F.col("url")) & (named | documents_page(F.col("url"))))
    best = cand.groupBy("region_url").agg(F.min_by("url", F.struct(-score, F.col("url"))).alias("best"))
    rows = regions.select(u.normalize(F.col("region_url")).alias("region_url")).distinct().join(best, "region_url", "left")
    return rows.select("region_url", F.when(documents_page(r), r).otherwise(F.coalesce("best", F.get(documents_candidates(r), F.lit(0)))).alias("documents_url"))


def entry_pages(documents: DataFrame, links: DataFrame) -> DataFrame:
    """(documents_url, pos, url) of the links of documents pages that open gazettes: of the region, or of another government host. A documents page that is one itself comes first, at -1."""
    at = F.col("documents_url")
    l = links.select(F.col("page_url").alias("documents_url"), "pos", "url", "text").join(documents.select("documents_url").distinct(), "documents_url", "left_semi")
    slug, home = region_slug(at), u.same_host(F.col("url"), at)
    ok = F.when(home, (slug == "") | same_region(F.col("url"), slug)).otherwise(trusted_candidate(F.col("url"), F.col("text"), at, F.lit(True)))
    found = l.where(ok & html_page(F.col("url")) & has_context(F.col("url"), F.col("text"))).select("documents_url", "pos", "url")
    own = documents.select("documents_url").distinct().where(has_context(at)).select("documents_url", F.lit(-1).alias("pos"), at.alias("url"))
    return ordered_distinct(found.unionByName(own), ["documents_url", "url"], ["pos"])


def expand(entry: str, links: DataFrame, pages: DataFrame | None = None, slug: str | None = None, max_depth: int = terms.GAZETTE_DEPTH, max_scans: int = terms.GAZETTE_SCANS, max_roots: int = terms.GAZETTE_ROOTS, years=None, months=None) -> tuple[list[str], list[str], list[str]]:
    """(found, scanned, errors) of the traversal from one entry page.

    A level is one job over the links of its pages, max_scans pages at the most: it computes what doesn't depend on the traversal's
    state. Trusted roots depend on the order of links, so that part, three roots at the most, is settled here in order. pages (url): those that
    can be read; others are scanned in vain.
    """
    spark = links.sparkSession
    start, _ = ln._normal(entry)
    first = spark.range(1).select(F.lit(start).alias("u"), region_slug(F.lit(start)).alias("slug"), has_context(F.lit(start)).alias("lists"), in_scope(F.lit(start), "", years, months).alias("scope")).first()
    slug = slug or first.slug
    found: dict[str, None] = {}
    scanned, errors, roots = [], [], []
    front, queued = [(start, first.lists and first.scope, first.lists)], {start}
    readable = None if pages is None else pages.select(u.normalize(F.col("url")).alias("page_url")).distinct()

    def above(url: str) -> bool:
        return any(_host(r) == _host(url) and (_path(url) == "/" or _path(r) == _path(url) or _path(r).startswith(_path(url) + "/")) for r in roots)

    for depth in range(max_depth + 1):
        room = max_scans - len(scanned) if max_scans else len(front)
        if len(front) > room:
            errors.append(f"raa_scan_cap_reached:{entry}:{max_scans}")
        front = front[:room]
        if not front:
            break
        level = spark.createDataFrame([(i, f[0]) for i, f in enumerate(front)], "n int, page_url string")
        url, text, src, root = F.col("url"), F.col("text"), F.col("page_url"), F.lit(start)
        rows = links.select("page_url", "pos", "url", "text").join(F.broadcast(level), "page_url").where(html_page(url) & in_scope(url, text, years, months))
        branch = (src == root) | has_context(src)
        none = F.expr("cast(array() as array<string>)")
        flags = {
            "ctx": has_context(url, text),
            "bare": has_context(url),
            "dated": year_or_month(url, text) | pagination(url, text),
            "page": year_or_month(url, text),
            "other_host": ~u.same_host(url, src) & government_host(url) & ~u.host_in(url, terms.BLOCKED_HOSTS),
            "plain": follows(url, text, F.lit(slug), root, src, none, years, months),
            "branch": branch,
            "in_scope": in_scope(url, "", years, months),
        }
        got = rows.select("n", "pos", "url", *[v.alias(k) for k, v in flags.items()]).orderBy("n", "pos").collect()  # the links of one level
        by_page: dict[int, list] = {}
        for r in got:
            by_page.setdefault(r.n, []).append(r)
        missing = set() if readable is None else {f[0] for f in front} - {r.page_url for r in level.join(readable, "page_url", "left_semi").collect()}
        nxt = []
        for n, (page, lists, _) in enumerate(front):
            scanned.append(page)
            if page in missing:
                errors.append(f"raa_fetch_failed:{page}:not stored")
                continue
            if lists:
                found[page] = None
            for r in by_page.get(n, ()):
                trusted_source = above(page)
                candidate = r.other_host and (r.branch or trusted_source) and r.ctx
                home = _host(r.url) == _host(start)
                if candidate or (home and r.plain):
                    go = True
                elif home:
                    go = False
                elif above(r.url):
                    go = r.ctx or r.dated
                else:
                    go = trusted_source and _host(r.url) == _host(page) and r.ctx
                if not go:
                    continue
                if not home and not above(r.url) and (candidate or trusted_source and _host(r.url) == _host(page) and r.ctx):
                    if len(roots) >= max_roots:
                        errors.append(f"trusted_external_root_cap_reached:{r.url}")
                        continue
                    roots.append(r.url)
                if r.ctx or r.page:
                    found[r.url] = None
                if r.url not in queued:
                    queued.add(r.url)
                    nxt.append((r.url, r.bare and r.in_scope, r.bare))
        front = nxt
    return list(found), list(dict.fromkeys(scanned)), list(dict.fromkeys(errors))


def _host(url: str) -> str:
    import re

    return (re.match(u.SPLIT, url)[2] or "").lower()


def _path(url: str) -> str:
    return ln._normal(url)[1]


def page_rank(url: Column) -> Column:
    """How promising a page of gazettes is: a year, the later the better, a month, its name; less for further pages of a listing."""
    year = d.year_in(url)
    out = F.when(year.isNotNull(), 100 + F.greatest(F.lit(0), year.cast("int") - 2010)).otherwise(0) + F.when(tx.let(path_text(url), lambda t: tx.any_of(t, terms.MONTHS)), 25).otherwise(0)
    return out + F.when(has_context(url), 20).otherwise(0) - F.when(pagination(url), 25).otherwise(0)


def pages_to_extract(pages: DataFrame, most: int = terms.GAZETTE_PAGES) -> DataFrame:
    """pages (url, seq), the first of each address; the most promising ones if there are more than most (0: no limit)."""
    once = ordered_distinct(pages, ["url"], ["seq"])
    if not most or once.limit(most + 1).count() <= most:
        return once.orderBy("seq")
    return once.orderBy(page_rank(F.col("url")).desc(), "url").limit(most)


def dated_links(outlines: DataFrame) -> DataFrame:
    """Links of outlines (sources.html.outlines) with their text and the context of headings before them: the last year, the last heading with a month, and the nearest text."""
    head = F.col("tag") != "a"
    year, month = F.when(head, d.year_in(F.col("text"))), F.when(head & (d.month_in(F.col("text")) != ""), F.col("text"))
    rows = outlines.withColumns({"_year": locf(year, ["page_id"], ["pos"]), "_month": locf(month, ["page_id"], ["pos"])}).where(~head & F.col("href").isNotNull())
    rows = rows.where(~u.is_non_http(F.col("href")) & ~u.is_bare_email(F.col("href")))
    rows = ln.absolute(rows).withColumn("url", u.normalize(F.col("url"))).where(u.scheme(F.col("url")).isin("http", "https"))
    join = lambda *c: F.array_join(F.filter(F.array(*[F.coalesce(x, F.lit("")) for x in c]), lambda v: v != ""), " ")
    return rows.select("page_id", "page_url", "pos", "url", join(F.col("text"), F.col("label")).alias("text"), join(F.col("_year"), F.col("_month"), F.col("previous")).alias("heading_context"))


def extract_documents(outlines: DataFrame, contexts: DataFrame, region: Column, days: int | None = None, today: date | None = None) -> DataFrame:
    """A row for each document of gazette pages, with its year, month and date from the best of its sources; n_same: pages that link to it besides the first.

    outlines as sources.html.outlines gives them, page_id their order; contexts (page_id, date_context). Within a page a link with a date
    replaces one without; of several pages the first counts.
    """
    pdf = dated_links(outlines).where(F.lower("url").contains(".pdf"))
    both = d.publication_date(F.col("text")).isNotNull() | d.publication_date(F.col("heading_context")).isNotNull()
    one = first_unless_upgraded(pdf, ["page_id", "page_url", "url"], F.col("pos"), both, ["text", "heading_context"]).join(contexts.select("page_id", "date_context"), "page_id", "left")
    name = F.regexp_extract(u.unquote(u.path(F.col("url"))), r"([^/]*)/*$", 1)
    rows = one.withColumn("title", name)
    sources = [("link_text", "text"), ("heading_context", "heading_context"), ("filename", "title"), ("pdf_url", "url"), ("source_page", "date_context"), ("source_page", "page_url")]
    order = [F.col(c) for c in ("page_url", "heading_context", "text", "title")]
    rows = rows.withColumn("_date", d.date_with_source(*[(s, F.col(c)) for s, c in sources]))
    rows = rows.select("page_id", "first_at", "url", "title", F.lit("PDF").alias("file_format"), F.lit("gazette").alias("source"), F.col("page_url").alias("source_page"), region.alias("region"), F.coalesce(d.year_in(*order), F.lit("unknown-year")).alias("year"), d.month_in(*order).alias("month"), "_date.*")
    rows = rows.withColumn("is_within_date_window", d.in_window(F.col("publication_date"), days, today))
    first = F.min_by(F.struct(*rows.columns), F.struct("page_id", "first_at"))
    return rows.groupBy(F.col("url").alias("_u")).agg(first.alias("r"), (F.count("*") - 1).alias("n_same")).select("r.*", "n_same")


def region_stats(documents: DataFrame) -> DataFrame:
    years = F.sort_array(F.collect_set(F.when(F.col("year") != "", F.col("year"))), False)
    return documents.groupBy("region").agg(F.count("*").alias("documents"), years.alias("available_years"), F.count_if("is_within_date_window").alias("pdfs_in_date_window"), F.count_if(F.coalesce("publication_date", F.lit("")) == "").alias("unknown_date_pdfs"), F.coalesce(F.sum("n_same"), F.lit(0)).alias("duplicate_pdf_links"))


def select_documents(documents: DataFrame, order: list[str], days: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents to download, counters): the first of each address, those in the window if there is one, most of each region in order."""
    once = ordered_distinct(documents.withColumn("_key", u.normalize(F.coalesce("url", F.lit("")))), ["_key"], order).drop("_key")
    fits = once.where("is_within_date_window") if days and days > 0 else once
    chosen = cap_per_group(fits.withColumn("region", F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown-region"))), ["region"], order, most)
    links, docs, ok, taken = documents.agg(F.count("*").alias("links")), once.agg(F.count("*").alias("docs"), F.count_if(F.coalesce("publication_date", F.lit("")) == "").alias("unknown_date_pdfs"), F.count_if("is_within_date_window").alias("pdfs_in_date_window")), fits.agg(F.count("*").alias("ok")), chosen.agg(F.count("*").alias("selected"))
    less = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b))
    counts = links.crossJoin(docs).crossJoin(ok).crossJoin(taken)  # one row each
    return chosen, counts.select("selected", "pdfs_in_date_window", "unknown_date_pdfs", less("docs", "ok").alias("skipped_by_date_filter"), less("links", "docs").alias("duplicate_pdf_links_skipped"), less("ok", "selected").alias("skipped_by_region_limit"))


def discover(start_url: str, pages: DataFrame, most_pages: int = terms.GAZETTE_PAGES, days: int | None = None, today: date | None = None, exclude_regions: Iterable[str] = (), years=None, months=None) -> tuple[DataFrame, DataFrame]:
    """(documents, per-region statistics) from stored pages (page_id, url, html): regions, their documents pages, entries, traversal, extraction."""
    from ..sources import html

    spark = pages.sparkSession
    stored = pages.withColumn("url", u.normalize(F.col("url")))
    raw = html.links(stored).where("kind = 'a'")
    links = ln.page_links(raw)
    start, _ = ln._normal(start_url)
    shape = spark.range(1).select(documents_page(F.lit(start)).alias("docs"), (has_context(F.lit(start)) & government_host(F.lit(start))).alias("own"), u.depth(F.lit(start)).alias("depth"), region_slug(F.lit(start)).alias("slug")).first()
    one = lambda r, doc: spark.createDataFrame([(r, doc)], "region_url string, documents_url string")
    if shape.docs:
        import re

        head = re.match(r"^[^:]+://[^/]+", start)
        mapping = one(f"{head[0]}/{shape.slug}" if shape.slug and head else start, start)
    elif shape.own:
        mapping = one(start, start)
    else:
        regions = one(start, None).select("region_url") if shape.depth == 1 else region_pages(links, start).select(F.col("url").alias("region_url"))
        mapping = documents_pages(regions, links)
    gone = [str(r).lower() for r in exclude_regions]
    mapping = mapping.withColumn("region", region_slug(F.col("region_url"))).where(F.col("documents_url").isNotNull() & ~F.col("region").isin(*gone)) if gone else mapping.withColumn("region", region_slug(F.col("region_url"))).where("documents_url is not null")
    entries = mapping.join(entry_pages(mapping, links), "documents_url").orderBy("region_url", "pos").collect()  # one row for each entry page of a region
    found: dict[str, dict[str, None]] = {}
    for e in entries:
        region = e.region or "unknown-region"
        got, _, _ = expand(e.url, links, stored, region, years=years, months=months)
        found.setdefault(region, {}).update(dict.fromkeys(got))
    rows = [(region, n, p) for region, ps in found.items() for n, p in enumerate(ps)]
    chosen = None
    for region in found:
        own = pages_to_extract(spark.createDataFrame([r for r in rows if r[0] == region], "region string, seq int, url string"), most_pages)
        chosen = own if chosen is None else chosen.unionByName(own)
    if chosen is None:
        chosen = spark.createDataFrame([], "region string, seq int, url string")
    read = stored.join(F.broadcast(chosen), "url").withColumn("page_id", F.struct("region", "seq"))
    flat = read.select(F.concat_ws("\t", "region", F.lpad(F.col("seq").cast("string"), 9, "0")).alias("page_id"), "url", "html")
    docs = extract_documents(html.outlines(flat), html.page_texts(flat), F.split_part(F.col("page_id"), F.lit("\t"), F.lit(1)), days, today)
    return docs, region_stats(docs)
