"""Downloaded files: names, folders, and a writer whose result is a status row for each file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators.ordered import collision_suffix

STATUS = "seq long, url string, file_path string, filename string, folder string, bytes long, status string"


def plan(files: DataFrame, root: str, subfolders: bool = True, by_region: bool = False) -> DataFrame:
    """files (seq, url, content_type, disposition, file_format and, for by_region, region and year) with folder and filename.

    The name is that of the header, else of the address; its extension that of the content type, else of the address, else of the declared format.
    Later files of a folder with a name already used get a number. HTML is no file: folder and filename are null.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    declared = F.concat(F.lit("."), F.regexp_replace(F.lower(F.coalesce(F.nullif("file_format", F.lit("")), F.lit("bin"))), r"^\.+", ""))
    ext = F.coalesce(F.nullif(u.content_type_extension(kind), F.lit("")), F.nullif(u.extension(F.col("url")), F.lit("")), declared)
    head = u.header_filename(F.coalesce("disposition", F.lit("")))
    name = F.when(head.isNotNull(), u.sanitize(head)).otherwise(u.filename(F.col("url"), F.col("seq") + 1, ext))
    name = F.when(name.rlike(r"^.+\.[^.]+$"), name).otherwise(F.concat(name, ext))
    folder = F.lit(root)
    if by_region:
        folder = F.concat_ws("/", folder, u.sanitize(F.coalesce(F.nullif("region", F.lit("")), F.lit("unknown-region"))), u.sanitize(F.coalesce(F.nullif("year", F.lit("")), F.lit("unknown-year"))))
    if subfolders:
        folder = F.concat_ws("/", folder, u.category_folder(F.col("url"), F.col("file_format"), kind))
    web = kind.contains("text/html")
    rows = files.withColumns({"folder": F.when(~web, folder), "filename": F.when(~web, name)})
    return rows.withColumn("filename", F.when(F.col("filename").isNotNull(), collision_suffix(F.col("folder"), F.col("filename"), F.col("seq"))))


def write(planned: DataFrame) -> DataFrame:
    """Writes the content of planned files; a status row for each. A file is written under another name first, so that a repeated task leaves it whole."""
    rows = planned.select("seq", "url", "folder", "filename", "content")

    def run(batches):
        import os
        import uuid

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    if r.filename is None:
                        raise ValueError("download endpoint returned HTML instead of a downloadable file")
                    if r.content is None:
                        raise ValueError("no content")
                    os.makedirs(r.folder, exist_ok=True)
                    path = os.path.join(r.folder, r.filename)
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with open(part, "wb") as f:
                        f.write(r.content)
                    os.replace(part, path)
                    out.append((r.seq, r.url, path, r.filename, r.folder, len(r.content), "downloaded"))
                except (OSError, ValueError) as e:
                    out.append((r.seq, r.url, "", "", "", 0, f"failed: {e}"))
            yield pd.DataFrame(out, columns=["seq", "url", "file_path", "filename", "folder", "bytes", "status"])

    return rows.mapInPandas(run, STATUS)


def sheets(page: DataFrame) -> dict[str, DataFrame]:
    """Tables of a report on page results: summary (a row for each figure), content, links."""
    summary = page.select("page_id", F.expr("stack(4, 'URL', url, 'Title', title, 'Links', cast(size(links) as string), 'Characters', cast(length(markdown) as string)) as (field, value)"))
    return {"Summary": summary, "Scraped Content": page.select("page_id", "title", "markdown"), "Links": page.select("page_id", F.posexplode("links").alias("pos", "link"))}
