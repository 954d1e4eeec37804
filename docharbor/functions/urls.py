"""URL expressions over the generic syntax of RFC 3986. An empty part is an empty string; null in, null out."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin as _join

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import terms
from . import text as tx

SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#((?s:.*)))?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, SPLIT, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def unquote(col: Column) -> Column:
    """Percent escapes decoded, a plus left alone; unchanged where an escape is broken."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def low_path(url: Column) -> Column:
    return F.lower(unquote(path(url)))


def build(scheme_: Column, netloc_: Column, path_: Column, query_: Column) -> Column:
    lead = F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise("")
    host = F.when(netloc_ != "", F.concat(F.lit("//"), netloc_)).otherwise("")
    tail = F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise("")
    return F.concat(lead, host, path_, tail)


def prefix(url: Column) -> Column:
    """The path without slashes at its end; / for none."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slashes at the path's end; an empty path is /."""
    return build(scheme(url), netloc(url), prefix(url), query(url))


def with_scheme(url: Column) -> Column:
    u = tx.strip(url)
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def same_host(a: Column, b: Column) -> Column:
    return netloc(a) == netloc(b)


def same_family(url: Column, start: Column, hosts: bool = False) -> Column:
    """url's path is start's or below it (and the hosts are equal, if that is asked)."""
    p, s = prefix(url), prefix(start)
    out = (s == "/") | (p == s) | p.startswith(F.concat(s, F.lit("/")))
    return same_host(url, start) & out if hosts else out


def _suffix(name: Column) -> Column:
    """The last extension of a file name, in lower case; none for a name that only begins with a dot or ends with one."""
    return F.regexp_extract(F.lower(name), r"[^/.][^/]*?(\.[^./]+)$", 1)


def _name(path_: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path_, "/+$", ""), r"([^/]*)$", 1)


def query_pairs(url: Column) -> Column:
    """Key and value of each part of the query, decoded, in order."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")

    def pair(p):
        at = F.instr(p, "=")
        dec = lambda c: F.coalesce(F.try_url_decode(c), c)
        return F.struct(dec(F.when(at > 0, F.substr(p, F.lit(1), at - 1)).otherwise(p)).alias("key"), dec(F.when(at > 0, F.substr(p, at + 1)).otherwise("")).alias("value"))

    return F.transform(parts, pair)


def extension(url: Column) -> Column:
    """The supported file extension of the path, else the first of a query value, keys in the order of their first use; else empty."""
    own = _suffix(_name(unquote(path(url))))
    pairs = query_pairs(url)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    ordered = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)))
    found = F.filter(F.transform(ordered, lambda p: _suffix(_name(unquote(p["value"])))), lambda e: e.isin(*terms.FILE_EXTENSIONS))
    return F.when(own.isin(*terms.FILE_EXTENSIONS), own).otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit("")))


def content_type_extension(content_type: Column) -> Column:
    bare = F.lower(tx.strip(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    table = F.create_map(*[F.lit(x) for kv in terms.CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, bare), F.lit(""))


def sanitize(name: Column, fallback: Column | str = "download") -> Column:
    """A file name without reserved characters; blanks and dots off its ends."""
    out = F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" ."))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback) if isinstance(fallback, str) else fallback)


def header_filename(disposition: Column) -> Column:
    """The file name in a content disposition; null if it has none."""
    p = r"""(?i)filename\*?=(?:UTF-8'')?"?([^";]+)"?"""
    return F.when(disposition.rlike(p), tx.strip(unquote(F.regexp_extract(disposition, p, 1))))


def filename(url: Column, index: Column, default: Column | str = ".bin") -> Column:
    """The last path component, or document_<index>; with the default extension if it has none."""
    default = F.lit(default) if isinstance(default, str) else default
    name = _name(unquote(path(url)))
    fallback = F.concat(F.lit("document_"), index.cast("string"), default)
    name = F.when(name == "", fallback).otherwise(name)
    return sanitize(F.when(_suffix(name) == "", F.concat(name, default)).otherwise(name), fallback)


def category_folder(url: Column, file_format: Column, content_type: Column | str = "") -> Column:
    content_type = F.lit(content_type) if isinstance(content_type, str) else content_type
    ext = F.coalesce(F.nullif(content_type_extension(content_type), F.lit("")), extension(url))
    fmt = F.concat(F.lit("."), F.regexp_replace(F.lower(F.coalesce(file_format, F.lit(""))), r"^\.+", ""))
    return F.when(ext.isin(*terms.IMAGE_EXTENSIONS) | fmt.isin(*terms.IMAGE_EXTENSIONS), "images").otherwise("documents")


def download_dir(url: Column, root: str = "downloads/pdfs") -> Column:
    """root / host / the first two path segments."""
    bits = F.slice(segments(url), 1, 2)
    tail = F.when(F.size(bits) == 0, "root").otherwise(F.array_join(F.transform(bits, lambda b: sanitize(b)), "_"))
    return F.concat_ws("/", F.lit(root), sanitize(F.coalesce(F.nullif(_part(url, 2), F.lit("")), F.lit("unknown-domain"))), tail)


def folder_name(index: Column, document_id: Column, title: Column, url: Column) -> Column:
    number = F.lpad(index.cast("string"), 4, "0")
    stem = F.regexp_replace(_name(unquote(path(url))), r"(?<=[^.])\.[^.]+$", "")
    title = F.coalesce(F.nullif(title, F.lit("")), stem)
    return sanitize(F.concat_ws("_", number, F.coalesce(F.nullif(document_id, F.lit("")), number), title), F.concat(number, F.lit("_document")))


def document_url(url: Column, pdf_url: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(pdf_url, F.lit("")), F.lit(""))


def srcset(value: Column) -> Column:
    """The URLs of a srcset attribute. An empty entry is left out."""
    first = F.transform(F.split(value, ","), lambda x: F.get(F.split(tx.strip(x), r"(?U)\s+"), F.lit(0)))
    return F.filter(first, lambda x: x != "")


def _has_key(name: str):
    return lambda p: p["key"] == name


def listing_params(url: Column) -> Column:
    """Query parameters of a listing page under their names in its interface; the last non-empty value counts."""
    pairs = F.filter(query_pairs(url), lambda p: p["value"] != "")
    out = []
    for source, target in terms.LISTING_PARAMS.items():
        own = F.filter(pairs, _has_key(source))
        out.append(F.when(F.size(own) > 0, F.struct(F.lit(target).alias("key"), F.element_at(own, -1)["value"].alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*out)))


def root_relative(page: Column, href: Column) -> Column:
    """Page and a href that begins with one slash, joined in the JVM; null for other hrefs."""
    return F.when(href.rlike("^/(?!/)"), F.concat(scheme(page), F.lit("://"), _part(page, 2), href))


@F.pandas_udf(T.StringType())
def urljoin(page: pd.Series, href: pd.Series) -> pd.Series:
    def one(p, h):
        try:
            return None if p is None or h is None else _join(p, h)
        except ValueError:
            return None

    return pd.Series([one(p, h) for p, h in zip(page, href, strict=True)], dtype=object)


def is_non_http(href: Column) -> Column:
    return F.lower(tx.strip(F.coalesce(href, F.lit("")))).rlike("^(mailto:|javascript:|tel:|#)")


def is_bare_email(href: Column) -> Column:
    h = tx.strip(F.coalesce(href, F.lit("")))
    return h.contains("@") & ~F.lower(h).rlike("^(http://|https://|mailto:)") & ~h.startswith("/")


def host_in(url: Column, hosts: Iterable[str]) -> Column:
    """The host is one of these or below one."""
    n, out = netloc(url), F.lit(False)
    for h in hosts:
        out = out | (n == h) | n.endswith(f".{h}")
    return out


def canonical_us(url: Column) -> Column:
    """Known sites' addresses rewritten to their pages in American English."""
    host, p = netloc(url), F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))
    swap = lambda old, new: F.concat(F.lit(new), F.substr(p, F.lit(len(old) + 1)))
    siemens, philips, roche = host.contains("siemens-healthineers.com"), host.contains("philips.com") & ~host.contains("usa.philips.com"), host.contains("diagnostics.roche.com")
    new_host = F.when(siemens & host.startswith("www."), "www.siemens-healthineers.com").when(~siemens & philips, "www.usa.philips.com").otherwise(host)
    own = F.when(p.isin("/", "/de", "/de/"), "/en-us").when(p.startswith("/de/"), swap("/de/", "/en-us/")).when(p == "/en", "/en-us").when(p.startswith("/en/"), swap("/en/", "/en-us/")).otherwise(p)
    at = F.instr(p, "/global/")
    lab = F.when(p == "/", "/us/en.html").when(at > 0, F.concat(F.substr(p, F.lit(1), at - 1), F.lit("/us/en/"), F.substr(p, at + 8))).otherwise(p)
    ge = host.contains("gehealthcare.com")
    new_path = F.when(siemens, own).when(philips | ge, p).when(roche, lab).otherwise(p)
    frag = fragment(url)
    return F.concat(build(scheme(url), new_host, new_path, query(url)), F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""))


def locale_path(p: Column, replacement: str) -> Column:
    """The first path segment replaced, if it has two characters or names a locale; else the path as it is."""
    segs = F.filter(F.split(p, "/"), lambda s: s != "")
    first = F.get(segs, F.lit(0))
    rest = F.slice(segs, F.lit(2), F.greatest(F.size(segs), F.lit(1)))
    return F.when(first.isNotNull() & ((F.length(first) == 2) | F.lower(first).isin(*terms.LOCALES)), F.concat(F.lit("/"), F.array_join(F.concat(F.array(F.lit(replacement)), rest), "/"))).otherwise(p)


def retry_candidates(url: Column, links: Column, most: int = 8) -> Column:
    """Other addresses to try for a page: its locale variants, its home page, and links of its host that look useful. In order, without repeats or the page itself."""
    current = canonical_us(url)
    p, rebuilt = path(current), lambda q: build(scheme(current), netloc(current), q, query(current))
    tries = [F.when(locale_path(p, r) != p, rebuilt(locale_path(p, r))) for r in terms.LOCALES]
    german = p.startswith("/de/") | (p == "/de")
    bare = F.substr(p, F.lit(4))
    tries += [F.when(german, rebuilt(F.concat(F.lit("/en-us"), bare))), F.when(german, rebuilt(F.when(bare == "", "/").otherwise(bare)))]
    tries.append(F.when((p != "") & (p != "/"), rebuilt(F.lit("/"))))
    own = F.filter(links, lambda x: (netloc(x) == netloc(current)) & ~tx.any_of(F.lower(x), terms.LINK_NOISE))
    own = F.filter(F.transform(own, canonical_us), lambda x: tx.any_of(F.lower(x), terms.LOCALES) | tx.any_of(F.lower(x), terms.CONTENT_HINTS))
    return F.array_remove(F.array_distinct(F.concat(F.array_compact(F.array(*tries)), F.slice(own, 1, most))), current)
