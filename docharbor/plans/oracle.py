"""Pieces of DuckDB SQL for the oracle of each query, built from the same fixed values."""

from __future__ import annotations

from .. import terms

SPLIT = "^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def contains_any(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def hits(x: str, words) -> str:
    return "(" + " + ".join(f"cast(contains({x}, {q(w)}) as int)" for w in words) + ")"


def occurrences(x: str, words) -> str:
    return "(" + " + ".join(f"((length({x}) - length(replace({x}, {q(w)}, ''))) // {len(w)})" for w in words) + ")"


def pattern_hits(x: str, patterns) -> str:
    return "(" + " + ".join(f"cast(regexp_matches({x}, {q('(?i)' + p)}) as int)" for p in patterns) + ")"


def part(x: str, n: int) -> str:
    return f"regexp_extract({x}, {q(SPLIT)}, {n})"


def scheme(x: str) -> str:
    return f"lower({part(x, 1)})"


def host(x: str) -> str:
    return f"lower({part(x, 2)})"


def prefix(x: str) -> str:
    return f"coalesce(nullif(regexp_replace({part(x, 3)}, '/+$', ''), ''), '/')"


def normalize(x: str) -> str:
    return f"(case when {scheme(x)} <> '' then {scheme(x)} || ':' else '' end || case when {host(x)} <> '' then '//' || {host(x)} else '' end || {prefix(x)} || case when {part(x, 4)} <> '' then '?' || {part(x, 4)} else '' end)"


def family(a: str, b: str) -> str:
    return f"({prefix(b)} = '/' or {prefix(a)} = {prefix(b)} or starts_with({prefix(a)}, {prefix(b)} || '/'))"


def segments(x: str) -> str:
    return f"list_filter(string_split({part(x, 3)}, '/'), lambda s: s <> '')"


def first_hit(x: str, table: dict, default: str = "null") -> str:
    return "(case " + " ".join(f"when {contains_any(x, words)} then {q(k)}" for k, words in table.items()) + f" else {default} end)"


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[\\x09-\\x0D ]+', ' ', 'g'))"


A = "<a\\b[^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>"
LINKS = f"""raw as (
  select page_id, url as page_url, unnest(regexp_extract_all(html, {q(A)}, 1)) as href, unnest(regexp_extract_all(html, {q(A)}, 2)) as text,
    cast(unnest(range(len(regexp_extract_all(html, {q(A)}, 1)))) as int) as pos
  from pages
), links as (select *, {scheme("page_url")} || '://' || {part("page_url", 2)} || href as url from raw)"""


def useful(low: str) -> str:
    return f"({hits(low, terms.USEFUL_TERMS)} + {hits(low, terms.FAMILIES)} + {pattern_hits(low, terms.SPEC_PATTERNS)})"


def drop_line(x: str) -> str:
    low, noise = f"lower({x})", pattern_hits(x, terms.NOISE_PATTERNS)
    return f"({contains_any(low, terms.COOKIE_WORDS)} or (starts_with({x}, '|') and {noise} >= 1) or ({noise} >= 2 and {useful(low)} = 0))"


def lines(x: str) -> str:
    return f"list_filter(string_split({x}, chr(10)), lambda y: y <> '')"


def navigation(x: str) -> str:
    ls = lines(x)
    nav = f"len(list_filter({ls}, lambda y: {contains_any('lower(y)', terms.NAVIGATION)}))"
    return f"cast(len({ls}) = 0 or (len({ls}) >= 3 and len(list_filter({ls}, lambda y: length(y) <= 35)) / len({ls}) >= 0.8 and {nav} >= 2 and {useful(f'lower({x})')} <= {nav}) as int)"


PARTS = (
    ("noise_url", -2),
    ("table_like", -2),
    ("noise_terms", -2),
    ("fallback_page", -4),
    ("medical_terms", 1),
    ("product_family", 2),
    ("title_context", 1),
    ("title_family", 2),
    ("spec_pattern", 2),
    ("thin_block", -1),
    ("cookie_heavy", -3),
    ("junk_structure", -3),
    ("navigation_block", -4),
    ("sanitized", 0),
)


def block_parts(clean: str, block: str, url: str, title: str) -> str:
    """The list of what each reason of PARTS counts."""
    low, ls = f"lower({clean})", lines(clean)
    cookieish = f"len({ls}) >= 4 and len(list_filter({ls}, lambda y: not {contains_any('lower(y)', terms.COOKIE_WORDS)})) = 0"
    parts = [
        f"cast({contains_any(f'lower({url})', terms.URL_NOISE)} as int)",
        f"cast(len(list_filter({ls}, lambda y: starts_with(y, '|'))) >= 3 as int)",
        pattern_hits(clean, terms.NOISE_PATTERNS),
        pattern_hits(clean, terms.FALLBACK_PATTERNS),
        f"least({hits(low, terms.USEFUL_TERMS)}, 4)",
        hits(low, terms.FAMILIES),
        f"least({hits(f'lower({title})', terms.USEFUL_TERMS)}, 2)",
        hits(f"lower({title})", terms.FAMILIES),
        pattern_hits(clean, terms.SPEC_PATTERNS),
        f"cast(length({clean}) < 40 as int)",
        f"cast({occurrences(low, ['cookie'])} >= 2 or {occurrences(low, ['session'])} >= 2 as int)",
        f"cast(len({ls}) = 0 or ({cookieish}) or (length({clean}) - length(regexp_replace({clean}, '[0-9]', '', 'g')) > length({clean}) * 0.2 and not contains({low}, 'product')) as int)",
        navigation(clean),
        f"cast(length({clean}) < length({block}) as int)",
    ]
    return "[" + ", ".join(parts) + "]"


def weighted(parts: str) -> str:
    return "(" + " + ".join(f"{parts}[{n}] * ({w})" for n, (_, w) in enumerate(PARTS, 1)) + ")"


def reasons(parts: str) -> str:
    return "list_filter([" + ", ".join(f"case when {parts}[{n}] > 0 then {q(name)} end" for n, (name, _) in enumerate(PARTS, 1)) + "], lambda r: r is not null)"


def page_type(url: str, title: str, clean: str, n_out: str, fallback: str) -> str:
    label, hay = f"lower({url} || chr(10) || {title})", f"lower({url} || chr(10) || {title} || chr(10) || {clean})"
    return f"""case when {fallback} then 'fallback_noise' when {contains_any(f'lower({url})', terms.LEGAL_URL)} then 'legal_noise' when {contains_any(label, ('support', 'documentation'))} then 'support_noise'
when {pattern_hits(hay, terms.FALLBACK_PATTERNS)} > 0 then 'fallback_noise' when {contains_any(hay, ('product', 'system', 'scanner'))} then case when {contains_any(hay, terms.FAMILIES)} then 'product_detail' else 'product_category' end
when {clean} <> '' and length({clean}) < 160 and {n_out} > 0 then 'mixed_low_quality' else 'unknown' end"""
