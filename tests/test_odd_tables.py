"""Queries against their SQL in DuckDB over tables with odd rows."""

import oracle
from docharbor.plans import queries


def _compare(spark, folder, name: str, **tables) -> str:
    con = oracle.connection("")
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return oracle.compare(queries.QUERIES[name](spark, str(folder)), queries.SQL[name], con)


def test_page_title(spark, tmp_path):
    titles = [
        None,
        "",
        "<title>\u00a0 a\x0bb\n\nc &amp;amp; \u2003</title>",
        "<TITLE>x</TITLE>",
        "<title>a<b>c</title><title> &quot;d&quot;\x85&amp</title>",
        "\U0001f600<title>\u2028e \x85 </title>",
        "<title>\t\x1cz\x1c</title>",
        "<title>cut &amp;&amp</title>",
        "<title>f \u2028</title>",
    ]
    assert _compare(spark, tmp_path, "page_title", pages=spark.createDataFrame([(i, "https://a.org/", h) for i, h in enumerate(titles)], "page_id long, url string, html string")) == ""


TEXTS = [
    "",
    " a\nb",
    "a \n\nb ",
    "a b​\n c",
    "plain text\nof two lines\n\n\nA 3 Tesla scanner, 70 CM bore\n\na 3 tesla SCANNER, 70 cm\nbore",
    "|---|---|\n\n| x \\| y |\n\n|a|\n|b|\n|c|",
    "x\\\\|y\n\ncookie session\ncookie session cookie\nplain",
    "Größe und Straße, 12 mm\n\nGRÖSSE İ ſession 5 Km",
    "été ﬁn Ĳ ½\n\n日本語の製品 ١٢٣٤٥٦٧٨٩ 12345",
    "a\tb\rc\x0bd\x85e f\n\ng",
    "Home\nSearch\nContact us\n\n1234 5678 90\n\nsign up\nlog in now and sign up\n\nlog in\n",
]


def test_blocks_of_odd_texts(spark):
    """Blocks that are only cut, or taken as clean without a look at their lines, are what normalising each line gives."""
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from docharbor import terms
    from docharbor.functions import text as tx
    from docharbor.operators import blocks as bl

    def norm(line):
        return re.sub(r"[\s\x85  ]+", " ", line.replace(" ", " ").replace("​", "")).strip(" ").replace("\\|", "|")

    def blocks(text):
        lines = [norm(x) for x in re.split("\r\n|[\n\x0b\x0c\r\x85  ]", unicodedata.normalize("NFKC", text))]
        kept = "\n".join(x for x in lines if not re.search(terms.TABLE_RULE, x))
        return [b for b in (x.strip("\n") for x in re.split("\n{2,}", kept)) if b]

    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, markdown string")
    got = rows.select("id", bl.block_list(tx.compatible(F.col("markdown"))).alias("b")).orderBy("id").collect()
    assert [r.b for r in got] == [blocks(t) for t in TEXTS]
    owns = rows.select(F.explode(bl.block_list(tx.compatible(F.col("markdown")))).alias("b"))
    assert all(r[0] == r[1] for r in owns.select(bl.cleaned(F.col("b"))["clean"], bl.sanitize(F.col("b"))).collect())


def test_block_score_searches_few_patterns(spark):
    """White space is looked for once a page and in blocks with a dropped line, not in every line of every step."""
    from docharbor.operators import blocks as bl

    rows = spark.createDataFrame([(1, "a", "u", "t")], "id long, markdown string, url string, title string")
    plan = bl.score_blocks(rows, ["id"])._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"(?U)\s+") <= 2


SENTENCES = [None, "", "\n \n", "a. b. c. d", "a.  . \n. b. c. d", " first second. ", "　x　\r\ny. z.", ".\n.\n.\n.\na. b", "one.two. three.\x85four. five", "  Line\n line \nLINE  x\n\tline\n\nother"]


def test_text_summary_reads_the_head(spark, tmp_path):
    """Equal to cutting the whole text, with the split bounded."""
    from pyspark.sql import functions as F

    from docharbor.functions import text as tx

    rows = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id int, text string")
    whole = F.filter(F.transform(F.split("text", r"(?U)\.\s+"), tx.strip), lambda x: x != "")
    lines = F.filter(F.transform(tx.lines(F.col("text")), tx.strip), lambda x: x != "")
    pairs = rows.select(tx.summary(F.col("text")).alias("a"), F.array_join(F.slice(whole, 1, 3), ". ").alias("b"), tx.first_line(F.col("text")).alias("c"), F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in pairs)
    assert r"(?U)\.\s+, 4)" in rows.select(tx.summary(F.col("text")))._jdf.queryExecution().analyzed().toString()


def test_text_merge_distinct(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab"[i % 2], t) for i, t in enumerate(["a  B\nc", "A b\n\nc\nd", "C\na b\ne", " \n", "x\nX\nx y", None])], "doc_id long, source string, text string")
    assert _compare(spark, tmp_path, "text_merge_distinct", documents=docs) == ""
    plan = queries.QUERIES["text_merge_distinct"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\s+") == 1  # keys are made once


def test_site_map_makes_edges_once(spark, monkeypatch, tmp_path):
    from docharbor.operators import graph

    tags, own = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, tag="round": tags.append(tag) or own(df, tag))
    pages = spark.createDataFrame([(i, f"u{i}") for i in (1, 2, 3, 6, 10, 11, 12, 40)], "page_id long, url string")
    assert _compare(spark, tmp_path, "site_map", pages=pages) == ""
    assert tags[0] == "edges" and tags.count("edges") == 1


def test_rows_of_pages_leave_by_few(spark, monkeypatch):
    """Rows of a page leave a worker once there is enough of them; nested columns and nulls stay what they are."""
    from docharbor.sources import html

    held = []

    class Table:
        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pylist([{"page_id": i, "page_url": "u", "html": "x" * 1_000_000} for i in range(10)])
            held.extend(b.num_rows for b in run([batch]))
            return self

        schema = spark.createDataFrame([], "page_id long, page_url string, html string").schema

    class Pages:
        sparkSession = spark

        def select(self, *columns):
            return Table()

    html.expand(Pages(), lambda h, u: [{"a": {"k": h[:1]}, "b": None}], "a map<string,string>, b array<string>")
    assert held == [2] * 5
    page = spark.createDataFrame([(None, "https://a.org/", "<main><div><h2>T</h2><p>text of it</p></div></main>"), (2, None, None)], "page_id long, url string, html string")
    got = html.page_blocks(page).collect()
    assert [(r.page_id, r.pos, r.heading, r.provenance["source_tag"], r.table) for r in got] == [(None, 0, "T", "div", None)]
