"""Operators on small tables with the edge cases of their definitions."""

import json
from datetime import date

from pyspark.sql import functions as F

from docharbor import terms
from docharbor.operators import blocks as bl
from docharbor.operators import entities, gazette, graph, tracker
from docharbor.operators import links as ln
from docharbor.operators import ordered as od
from docharbor.plans import fixtures as fx
from docharbor.sources import fetch, html, listing, sinks
from docharbor.streaming import daily


def test_html_tree():
    root = html.parse("<div><p>a<b>b</p><img src=x>c</div></i>d<script>no</script>")
    assert root.text() == "a b c d"
    assert [n.tag for n in root.walk()] == ["div", "p", "b", "img", "script"]
    assert html.parse(None).text() == "" and html.semantic_text("") == ""


def test_links(spark):
    page = "<a href=' /a.pdf#x'>A</a><a href='/a.pdf#y'>again</a><a href='mailto:x@y.z'>m</a><a href='x@y.z'>m</a><a>none</a><img src='p.PNG'><source srcset='q.jpg 1x, r.gif 2x'><a href='ftp://z/a.pdf'>f</a>"
    pages = spark.createDataFrame([(1, "https://s.org/d/", page), (2, "https://s.org/", None)], "page_id long, url string, html string")
    links = html.links(pages)
    assert [r.url for r in ln.page_links(links.where("kind = 'a'")).orderBy("pos").collect()] == ["https://s.org/a.pdf"]
    assert [r.url for r in ln.file_links(links).orderBy("pos").collect()] == ["https://s.org/a.pdf", "https://s.org/d/p.PNG", "https://s.org/d/q.jpg", "https://s.org/d/r.gif"]
    assert ln.pdf_links(links).count() == 1
    both = ln.strategies(links.where("kind = 'img'"), links.where("kind = 'a'"))
    assert {r.url for r in both.collect()} == {"https://s.org/d/p.PNG", "https://s.org/a.pdf"}
    assert ln.document_rows(ln.file_links(links)).where("file_format = 'PDF'").first().title == "a.pdf"


def test_native_links_equal_parsed(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    a = {tuple(r) for r in ln.native_anchors(pages).select("page_id", "pos", "href").collect()}
    assert a == {tuple(r) for r in html.links(pages).where("kind = 'a'").select("page_id", "pos", "href").collect()}


def _page(spark, text, url="https://a.org/x", title=""):
    return bl.page_results(spark.createDataFrame([(1, text, url, title)], "id long, markdown string, url string, title string"), ["id"]).first()


def test_blocks(spark):
    got = _page(spark, "The Magnetom scanner system has a 3 tesla field and 70 cm bore.\n\n|cookie|x|\n|session|y|\n\nthe  MAGNETOM scanner system has a 3 tesla field and 70 cm bore.\n\nshort")
    assert got.useful_block_count == 1 and got.dropped_block_count == 3 and got.page_type == "product_detail"
    assert "duplicate_block" in got.dropped_reasons and "fully_sanitized" in got.dropped_reasons
    assert got.signals["product_families"] == ["magnetom"] and "3 tesla" in got.signals["spec_values"]
    assert got.relevance_score == got.kept_blocks[0].score > 0
    gone = _page(spark, "Page not found\n\nOur scanner product system platform solution is great and useful to all of us")
    assert gone.page_type == "fallback_noise" and gone.clean_text == "" and gone.useful_block_count == 0
    assert _page(spark, "", "https://a.org/privacy").page_type == "legal_noise"
    assert _page(spark, None).page_type == "unknown"


def test_block_cut(spark):
    rows = spark.createDataFrame([(1, "a  b\n|---|---|\nc\n\n\n d\n")], "id long, markdown string")
    assert [r.block for r in bl.split_blocks(rows, ["id"]).orderBy("pos").collect()] == ["a b\nc", "d"]
    assert rows.select(bl.navigation(F.lit("Home\nSearch\nContact us")), bl.junk(F.lit("12345 12345"))).first()[:] == (True, True)


def test_records(spark):
    pages = spark.createDataFrame(fx.CARDS, "page_id long, url string, title string, html string")
    found = {r.page_id: r for r in entities.product_records(html.page_blocks(pages), pages).collect()}
    assert set(found) == {1, 2, 4}  # an article with a heading holds all its texts and is itself no block
    assert found[1].technical_specs == {"field_strength": ["3 T"], "weight": ["450 kg"], "uptake_time": ["60 min"]} and found[1].product_family == "magnetom"
    assert found[4].product_name == "Empty page" and found[4].evidence_block_ids == ["page_root"]


def test_structured_page():
    found = html.blocks("<body><section id='s' class='a b c'><h2>T</h2><p>x</p><a href=' /l '>l</a></section><p>loose</p><nav><p>no</p></nav></body>", "u")
    assert [(b["block_type"], b["heading"]) for b in found] == [("card", "T"), ("text", "")]
    assert found[0]["links"] == ["/l"] and found[0]["provenance"]["source_path"] == "body[1]>section#s.a.b[1]"
    assert html.table_of(html.parse("<table><tr><th>Cookie</th></tr><tr><td>a</td><td> </td></tr></table>").first("table"))["table_type"] == "cookie_legal"


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "https://a.org/de/x", "<title>T</title><main><p>short</p></main><a href='/en/scanner'>s</a>"), (2, "https://a.org/en-us/x", "<title>Scanner</title><main><p>" + "A scanner system of great value. " * 12 + "</p></main>")], "page_id long, url string, html string")
    rows = fetch.page_rows(pages)
    got = {r.page_id: r for r in rows.collect()}
    assert got[2].source_quality == "good" and got[1].source_quality != "good" and got[1].retry_candidates[0] == "https://a.org/en-us/x"
    bad = rows.withColumn("source_quality", F.when(F.col("page_id") == 1, "bad_source_page").otherwise(F.col("source_quality")))
    assert {r.page_id: r.url for r in fetch.substitute_bad(bad, rows).collect()} == {1: "https://a.org/en-us/x", 2: "https://a.org/en-us/x"}


def test_fetch_errors_are_rows(spark):
    r = fetch.fetch(spark, ["http://127.0.0.1:9/x"]).first()
    assert r.success is False and r.error and r.url == "http://127.0.0.1:9/x"


def test_ordered(spark):
    rows = spark.createDataFrame([("d", "a.pdf", 1), ("d", "a.pdf", 2), ("d", "a.pdf", 3), ("e", "a.pdf", 4), ("d", "noext", 5), ("d", "noext", 6)], "f string, n string, o int")
    assert [r[0] for r in rows.select(od.collision_suffix(F.col("f"), F.col("n"), F.col("o")).alias("x"), "o").orderBy("o").collect()] == ["a.pdf", "a_1.pdf", "a_2.pdf", "a.pdf", "noext", "noext_1"]
    assert od.cap_per_group(rows, ["f"], ["o"], 2).count() == 3 and od.cap_per_group(rows, ["f"], ["o"], 0).count() == 6


def test_crawl(spark):
    pages = spark.createDataFrame([(f"https://s.org/p/{i}", i != 2) for i in range(8)], "url string, success boolean")
    edges = [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 0), (1, 0, 4), (2, 0, 7), (3, 0, 5), (5, 0, 6)]
    links = spark.createDataFrame([(f"https://s.org/p/{a}", p, f"https://s.org/p/{b}") for a, p, b in edges] + [("https://s.org/p/0", 9, "https://t.org/p"), ("https://s.org/p/0", 8, "https://s.org/login")], "src string, pos int, dst string")
    seq = lambda **k: [r.url[-1] for r in graph.crawl(pages, links, "https://s.org/p/0", include=["*/p/*"], **k).orderBy("seq").collect()]
    assert seq(max_depth=2, max_pages=50) == ["0", "1", "3", "4", "5"]
    assert seq(max_depth=3, max_pages=3) == ["0", "1", "3"]
    robots = spark.createDataFrame([("https://s.org", "User-agent: *\nDisallow: /p/1")], "host string, robots_txt string")
    assert seq(max_depth=1, robots=robots) == ["0", "3"]
    assert {r.url[-1] for r in graph.map_site(pages, links, "https://s.org/p/0").collect()} == set("0123456n")
    assert graph.bfs_depth(links.select("src", "dst"), spark.createDataFrame([], "node string")).count() == 0


def test_gazette(spark):
    pages = spark.createDataFrame(fx.SITE, "page_id long, url string, html string")
    docs, stats = gazette.discover(terms.PORTAL, pages, days=30, today=date(2026, 4, 30), exclude_regions=["corse"])
    got = {r.title: r for r in docs.collect()}
    assert set(got) == {"raa-12.pdf", "20260302_raa.pdf", "raa-fev.pdf", "raa_2019.pdf"}
    assert (got["raa-12.pdf"].publication_date, got["raa-12.pdf"].date_source, got["raa-12.pdf"].n_same) == ("2026-04-29", "heading_context", 1)
    assert (got["20260302_raa.pdf"].date_source, got["20260302_raa.pdf"].month) == ("filename", "March")
    assert got["raa_2019.pdf"].year == "2019" and got["raa-fev.pdf"].date_source == "unknown"
    assert stats.first().documents == 4
    found, scanned, errors = gazette.expand(fx._RAA, ln.page_links(html.links(pages).where("kind = 'a'")), pages, "bretagne", years=["2026"])
    assert not any("2019" in f for f in found) and len(scanned) == 3 and errors == []
    _, scanned, errors = gazette.expand(fx._RAA, ln.page_links(html.links(pages).where("kind = 'a'")), pages, "bretagne", max_scans=2)
    assert len(scanned) == 2 and errors[0].startswith("raa_scan_cap_reached")


def test_selection(spark):
    rows = spark.createDataFrame([(1, "https://a/x#1", "r", "2026-01-01", True), (2, "https://A/x", "r", "", False), (3, "https://a/y", "", "2026-01-01", True), (4, "https://a/z", None, "", False)], "seq long, url string, region string, publication_date string, is_within_date_window boolean")
    chosen, counts = gazette.select_documents(rows, ["seq"], 7, 1)
    assert sorted(r.seq for r in chosen.collect()) == [1, 3]
    assert counts.first().asDict() == {"selected": 2, "pdfs_in_date_window": 2, "unknown_date_pdfs": 1, "skipped_by_date_filter": 1, "duplicate_pdf_links_skipped": 1, "skipped_by_region_limit": 0}


def test_listing(spark):
    docs = listing.documents(spark.createDataFrame(fx.LISTINGS, "listing string, page_number int, body string"), 45)
    states = {r.state: r.n for r in docs.groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert states == {"document": 40, "skipped": 4, "duplicate": 1}
    assert listing.listing_counts(docs).first().records_scanned == 45
    req = spark.range(1).select(listing.page_requests(F.lit("https://d.org/documents?search=a"), 41)).first()[0]
    assert len(req) == 2 and "sort=-modified-at" in req[0] and "page=2" in req[1]
    assert [r.url for r in listing.dump_pdfs(spark.createDataFrame(fx.DUMPS, "page_id long, page_url string, body string")).collect()] == [listing.BLOBS + "abc/Spec.PDF"]


DOC = "seq long, url string, region string, year string, month string, publication_date string, date_source string, source_page string, title string"


def _docs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOC)


def test_upsert(spark):
    a = ("https://E.org/a#1", "R", "2026", "April", "", "", "p1", "t1")
    one = tracker.upsert(spark.createDataFrame([], tracker.DOCUMENTS), _docs(spark, a, ("https://e.org/a", "S", "2020", "May", "2026-04-01", "filename", "p2", "t2")), 1, F.lit("2026-01-01").cast("timestamp"), ["seq"]).first()
    assert (one.id, one.region, one.year, str(one.publication_date), one.date_source, one.title, one.pdf_url) == (1, "R", "2026", "2026-04-01", "filename", "t2", "https://E.org/a#1")
    base = tracker.upsert(spark.createDataFrame([], tracker.DOCUMENTS), _docs(spark, (*a[:5], "unknown", *a[6:])), 1, F.lit("2026-01-01").cast("timestamp"), ["seq"])
    two = tracker.upsert(base, _docs(spark, ("https://e.org/a", "S", "1", "x", "2026-04-01", "filename", "p2", "t2"), ("https://e.org/b", None, None, None, None, None, None, None)), 2, F.lit("2026-02-01").cast("timestamp"), ["seq"])
    r, s = two.orderBy("id").collect()
    assert (r.region, r.date_source, str(r.publication_date), r.first_run_id, r.last_run_id, r.source_page) == ("R", "unknown", "2026-04-01", 1, 2, "p2")
    assert (s.id, s.region, s.date_source, s.first_run_id) == (2, "unknown-region", "", 2)
    assert tracker.upsert(two, _docs(spark).limit(0), 3, F.lit("2026-03-01").cast("timestamp"), ["seq"]).count() == 2


def test_daily_runs(spark, tmp_path):
    repo = tracker.Repository(spark, f"file://{tmp_path}/repo")
    doc = lambda n, day, region="R": (f"https://e.org/{n}", region, "2026", "April", day, "filename", "p", f"t{n}")
    stock = [doc(1, "2026-04-01"), doc(2, "2026-03-01"), doc(3, "2026-04-02", "Corse")]
    discover = lambda years, months: _docs(spark, *stock)
    assert tracker.daily_check(repo, discover, ["seq"], date(2026, 4, 30))["status"] == "baseline_created"
    stock.append(doc(4, "2026-04-05"))
    got = tracker.daily_check(repo, discover, ["seq"], date(2026, 4, 30), str(tmp_path / "report"))
    assert (got["status"], got["pdfs_discovered"], got["already_known"], got["new_pdfs"]) == ("completed", 2, 1, 1)
    assert [r.title for r in got["new_documents"].collect()] == ["t4"] and (tmp_path / "report/inventory_snapshot").is_dir()
    status = lambda docs: docs.select("seq", F.when(F.col("title") == "t4", "downloaded").otherwise("failed: x").alias("status"), F.lit("/f").alias("file_path"))
    assert tracker.download_new(repo, got["run_id"], status)["downloaded"] == 1
    run = repo.daily_runs().where(F.col("id") == got["run_id"]).first()
    assert (run.downloaded, run.failed, run.status) == (1, 0, "completed") and repo.download_log().first().document_id == 3
    again = tracker.daily_check(repo, discover, ["seq"], date(2026, 4, 30))
    assert again["new_pdfs"] == 0 and repo.inventory().count() == 3

    def broken(years, months):
        raise RuntimeError("no site")

    try:
        tracker.daily_check(repo, broken, ["seq"], date(2026, 4, 30))
    except RuntimeError:
        pass
    last = repo.runs().orderBy(F.desc("id")).first()
    assert (last.status, last.error) == ("failed", "no site")


def test_sink(spark, tmp_path):
    rows = [(0, "https://a.org/x.pdf", "application/pdf", None, None, b"1"), (1, "https://b.org/x.pdf", "application/pdf", None, None, b"22"), (2, "https://a.org/i", "image/png", None, None, b"3"), (3, "https://a.org/h", "text/html", None, None, b"4"), (4, "https://a.org/n", None, 'attachment; filename="q?.csv"', "csv", b"5")]
    files = spark.createDataFrame(rows, "seq long, url string, content_type string, disposition string, file_format string, content binary")
    got = sinks.write(sinks.plan(files, str(tmp_path))).orderBy("seq").collect()
    assert [r.filename for r in got] == ["x.pdf", "x_1.pdf", "i.png", "", "q_.csv"] and got[3].status.startswith("failed:")
    assert (tmp_path / "documents/x_1.pdf").read_bytes() == b"22" and (tmp_path / "images/i.png").exists()


def test_stream(spark, tmp_path):
    repo = tracker.Repository(spark, f"file://{tmp_path}/repo")
    folder = tmp_path / "in"
    folder.mkdir()
    new = []

    def put(name, *urls):
        (folder / name).write_text("\n".join(json.dumps({"url": u, "title": u, "region": "R", "year": "2026", "month": "April", "publication_date": "", "date_source": "", "source_page": "", "seq": i}) for i, u in enumerate(urls)))
        daily.follow(spark, str(folder), repo, str(tmp_path / "cp"), lambda df, n: new.append(sorted(r.url for r in df.collect()))).awaitTermination()

    put("a.json", "https://e.org/1", "https://e.org/2", "https://E.org/1#x")
    put("b.json", "https://e.org/2", "https://e.org/3")
    assert new == [["https://e.org/1", "https://e.org/2"], ["https://e.org/3"]] and repo.inventory().count() == 3


def test_udtf(spark):
    html.register(spark)
    spark.createDataFrame([("<h1>T</h1><a href='/x'>l</a>",)], "html string").createOrReplaceTempView("raw_pages")
    assert [tuple(r) for r in spark.sql("select l.href, l.text from raw_pages, lateral html_links(html) l").collect()] == [("/x", "l")]
    assert spark.sql("select h.text from raw_pages, lateral html_headings(html) h").first()[0] == "T"


