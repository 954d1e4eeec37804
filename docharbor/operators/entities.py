"""Product records from the blocks of structured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..functions import text as tx

SPECS = "array<struct<name:string,values:array<string>>>"


def modality(x: Column) -> Column:
    return tx.first_hit(F.lower(x), terms.RECORD_MODALITIES, "unknown")


def family(x: Column) -> Column:
    return tx.first_hit(F.lower(x), {f: (f,) for f in terms.RECORD_FAMILIES}, "")


def parameters(x: Column) -> Column:
    """(name, values) of each parameter that a text states, in a fixed order; values squeezed, the first of those that differ in case only."""
    out = []
    for name, p in terms.PARAMETERS.items():
        values = tx.distinct_ci(F.regexp_extract_all(x, F.lit(f"(?iu){p}"), F.lit(int("([" in p))))
        out.append(F.when(F.size(values) > 0, F.struct(F.lit(name).alias("name"), values.alias("values"))))
    return F.array_compact(F.array(*out))


def is_candidate(kind: Column, heading: Column, text: Column, links: Column) -> Column:
    both = F.concat_ws("\n", heading, text)
    own = (kind == "section") & ((F.size(links) > 0) | (heading != "") | (F.length(text) >= 80))
    named = (family(both) != "") | (modality(both) != "unknown") | (tx.pattern_hits(both, terms.PARAMETERS.values()) > 0)
    return (kind == "card") | (kind.isin("section", "text", "heading") & (own | named))


def product_records(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """A record for each product of a page (page_id, url, title): blocks that look like one, else the page itself.

    Records of a page whose names differ in case only are one: the first gives name, modality, family and summary; values, parameters
    and blocks are joined in order without repeats.
    """
    first = blocks.where((F.col("heading") != "") | ((F.col("block_type") == "heading") & (F.col("text") != ""))).groupBy("page_id").agg(F.min_by(F.coalesce(F.nullif("heading", F.lit("")), "text"), "pos").alias("top"))
    text = blocks.groupBy("page_id").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), lambda t: t != ""), "\n\n").alias("page_text"))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("source_url"), F.coalesce("title", F.lit("")).alias("title")).join(first, "page_id", "left").join(text, "page_id", "left")
    base = base.fillna("", ["top", "page_text"])
    cand = blocks.where(is_candidate(F.col("block_type"), F.col("heading"), F.col("text"), F.col("links"))).select("page_id", "pos", "block_id", "block_type", "heading", "text")
    line = tx.first_line(F.col("text"))
    own = F.when(F.col("block_type").isin("card", "section"), F.nullif(line, F.lit("")))
    name = F.coalesce(F.nullif("heading", F.lit("")), own, F.nullif("top", F.lit("")), F.nullif("title", F.lit("")), line)
    rows = cand.join(base, "page_id").withColumn("product_name", name)
    alone = base.join(cand.select("page_id").distinct(), "page_id", "left_anti")
    alone = alone.select("page_id", F.lit(0).alias("pos"), F.lit("page_root").alias("block_id"), F.col("page_text").alias("text"), "source_url", "title", F.coalesce(F.nullif("title", F.lit("")), "top").alias("product_name")).where("product_name != ''")
    cols = ["page_id", "pos", "block_id", "text", "source_url", "title", "product_name"]
    rows = rows.select(*cols).unionByName(alone.select(*cols))
    rows = rows.withColumns({"modality": modality(F.concat_ws("\n", "title", "text")), "product_family": family(F.concat_ws("\n", "product_name", "text")), "summary": tx.summary(F.col("text")), "specs": parameters(F.col("text"))})
    head = F.min_by(F.struct("product_name", "modality", "product_family", "summary", "source_url"), "pos").alias("head")
    got = rows.groupBy("page_id", F.lower("product_name").alias("key")).agg(head, F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "block_id", "specs"))).alias("all"))
    every = F.flatten(F.transform("all", lambda r: F.transform(r["specs"], lambda s: F.struct(s["name"].alias("name"), s["values"].alias("values"), r["block_id"].alias("block")))))
    names = F.array_distinct(F.transform("every", lambda s: s["name"]))
    specs = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.array_distinct(F.flatten(F.transform(F.filter("every", lambda s: s["name"] == n), lambda s: s["values"]))).alias("value"))))
    params = F.array_distinct(F.flatten(F.transform("every", lambda s: F.transform(s["values"], lambda v: F.struct(s["name"].alias("name"), v.alias("value"), v.alias("evidence_text"), s["block"].alias("source_block_id"))))))
    return got.withColumn("every", every).select("page_id", "pos", "head.*", specs.alias("technical_specs"), params.alias("clinical_parameters"), F.array_distinct(F.transform("all", lambda r: r["block_id"])).alias("evidence_block_ids"))


def record_rows(records: DataFrame) -> DataFrame:
    """Records with flat text columns, for a sheet."""
    entries = F.transform(F.map_entries("technical_specs"), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    params = F.transform("clinical_parameters", lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    return records.select("page_id", "product_name", "modality", "product_family", "summary", F.array_join(entries, "; ").alias("technical_specs"), F.array_join(params, "; ").alias("clinical_parameters"), F.array_join("evidence_block_ids", ", ").alias("evidence_block_ids"), "source_url")
