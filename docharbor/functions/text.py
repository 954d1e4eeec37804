"""Text expressions: folding, white space, term and pattern hits. All stay in the JVM but for the composed normal form."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def any_of(col: Column, terms: Iterable[str]) -> Column:
    """Whether col contains one of the terms."""
    out = F.lit(False)
    for t in terms:
        out = out | col.contains(t)
    return out


def hits(col: Column, terms: Iterable[str]) -> Column:
    """How many of the terms col contains."""
    out = F.lit(0)
    for t in terms:
        out = out + col.contains(t).cast("int")
    return out


def occurrences(col: Column, terms: Iterable[str]) -> Column:
    """How often the terms occur in col, each counted on its own without overlaps. col is read often: bind it."""
    out = F.lit(0)
    for t in terms:
        n = F.floor((F.length(col) - F.length(F.replace(col, F.lit(t), F.lit("")))) / len(t)).cast("int")
        out = out + F.when(col.contains(t), n).otherwise(0)
    return out


#: Letters that match an ASCII letter of a pattern, but have another lower-case form.
ODD_CASES = "\u017f\u0131\u0307"


def needle(pattern: str) -> str:
    """The longest piece of lower-case text that every match of the pattern holds; empty if there is none."""
    plain = re.sub(r"\\b", "", pattern)
    plain = re.sub(r"\(\?:[^)]*\)[?*+]?|\\.[?*+]?|.[?*]", "\0", plain)
    return max(re.split(r"[\0+.()\[\]|^$\\]", plain), key=len, default="").lower()


#: Pieces of which every match of a pattern without a needle holds one.
PIECES = {r"\b\d+(?:\.\d+)?\s*(?:cm|mm)\b": ("cm", "mm")}


def needles(pattern: str) -> tuple[str, ...]:
    """Pieces of lower-case text of which every match of the pattern holds one; none if there are no such."""
    own = needle(pattern)
    return PIECES.get(pattern, (own,) if own else ())


def pattern_hits(col: Column, patterns: Iterable[str], low: Column | None = None, odd: Column | None = None) -> Column:
    """How many of the patterns match somewhere in col, whatever the case. A pattern is tried only where its needle occurs. low, odd: col in lower case and whether that holds an odd case, if they are at hand."""

    def count(x: Column) -> Column:
        low, odd = x["low"], x["odd"]
        out = F.lit(0)
        for p in patterns:
            own, found = needles(p), col.rlike(f"(?iu){p}")
            out = out + (F.when(any_of(low, own) | odd, found).otherwise(False) if own else found).cast("int")
        return out

    patterns = list(patterns)
    if low is not None:
        return count({"low": low, "odd": any_of(low, ODD_CASES) if odd is None else odd})
    return let(let(F.lower(col), lambda low: F.struct(low.alias("low"), any_of(low, ODD_CASES).alias("odd"))), count)


def first_hit(col: Column, table: dict[str, Iterable[str]], default: str | None = None) -> Column:
    """The first key one of whose terms col contains."""
    out = F.lit(default).cast("string")
    for key, terms in reversed(table.items()):
        out = F.when(any_of(col, terms), key).otherwise(out)
    return out


def found_terms(col: Column, terms: Iterable[str], most: int) -> Column:
    """The terms that col contains, sorted, at most so many."""
    return F.slice(F.array_compact(F.array(*[F.when(col.contains(t), t) for t in sorted(terms)])), 1, most)


#: Characters that are surely no white space, but for the space.
PLAIN = "!-~\u00a1-\u167f\u1681-\u1fff"


def collapse(col: Column) -> Column:
    """White space runs as one space, none at the ends. What is so already isn't rewritten."""

    def of(x: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")
        other = F.when(wide(x), x.rlike(f"[^ {PLAIN}]")).otherwise(x.rlike("[^ -~]"))
        return F.when(x.contains("  ") | x.startswith(" ") | x.endswith(" ") | other, clean).otherwise(x)

    return let(col, of)


def strip(col: Column) -> Column:
    def of(x: Column) -> Column:
        ends = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
        return F.when(ends.rlike(f"[^{PLAIN}]"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)

    return let(col, of)


def lines(col: Column) -> Column:
    """The lines of a text, by any kind of line break."""
    return let(col, lambda x: F.when(x.rlike("[\x0b-\r\x85\u2028\u2029]"), F.split(x, r"\R")).otherwise(F.split(x, "\n")))


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Of all characters with a decomposition: those that fold to one ASCII character, and those that fold to several."""
    one, many = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if unicodedata.decomposition(c := chr(code)):
            ascii_ = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            if len(ascii_) == 1:
                one[c] = ascii_
            elif ascii_:
                many[c] = ascii_
    return one, many


def _replaced(col: Column, one: dict[str, str], many: dict[str, str]) -> Column:
    pairs = F.from_json(F.lit(json.dumps([{"c": c, "a": a} for c, a in many.items()])), "array<struct<c:string,a:string>>")  # folded into one literal
    return F.translate(F.aggregate(pairs, col, lambda acc, p: F.replace(acc, p["c"], p["a"])), "".join(one), "".join(one.values()))


def ascii_fold(col: Column) -> Column:
    """The compatibility decomposition (NFKD) without what isn't ASCII. All in the JVM; ASCII is left as it is, and letters beyond Latin cost only the texts that have some."""
    one, many = _folds()
    latin, others = (({c: a for c, a in one.items() if (c < "\u0250") == x}, {c: a for c, a in many.items() if (c < "\u0250") == x}) for x in (True, False))

    def folded(x: Column) -> Column:
        x = F.when(x.rlike(f"[{''.join(latin[1])}]"), _replaced(x, {}, latin[1])).otherwise(x)
        return F.regexp_replace(F.translate(x, "".join(latin[0]), "".join(latin[0].values())), r"[^\x00-\x7F]", "")

    far = F.when(col.rlike("[^\\x00-\u024f\u0300-\u036f]"), _replaced(col, *others)).otherwise(col)
    return F.when(col.rlike(r"[^\x00-\x7F]"), let(far, folded)).otherwise(col)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def wide(col: Column) -> Column:
    """Whether col holds what isn't ASCII: lengths are compared, nothing is searched."""
    return F.octet_length(col) > F.char_length(col)


def compatible(col: Column) -> Column:
    """The compatibility form (NFKC). ASCII and letters that are their own form, with no mark that could join them, aren't sent to Python."""
    return F.coalesce(nfkc(F.when(wide(col) & col.rlike("[^\\x00-\\x7f\u00bf-\u0131]"), col)), col)


def norm_text(col: Column) -> Column:
    """Folded to ASCII, lower case, white space collapsed. Null is empty."""
    return collapse(F.lower(ascii_fold(F.coalesce(col, F.lit("")))))


def norm_line(col: Column) -> Column:
    """A line of a page in compatible form: no zero-width spaces, white space collapsed, pipes unescaped."""
    col = F.replace(F.replace(col, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    return F.replace(collapse(col), F.lit("\\|"), F.lit("|"))


def first_line(col: Column) -> Column:
    """The first line that isn't blank, stripped; empty if there is none. What follows it isn't looked at."""
    return F.coalesce(strip(F.regexp_extract(col, r"(?U)\A\s*([^\n\x0b\f\r\x85\u2028\u2029]*)", 1)), F.lit(""))


def summary(col: Column, sentences: int = 3) -> Column:
    """The first sentences, cut at a full stop before white space. Only a text that has blank ones among the first is cut to its end."""
    stop = r"(?U)\.\s+"

    def joined(parts: Column) -> Column:
        return F.array_join(F.slice(F.filter(parts, lambda x: x != ""), 1, sentences), ". ")

    def of(x: Column) -> Column:
        whole = joined(F.transform(F.split(x["text"], stop), strip))
        return F.when((F.size(x["first"]) > sentences) & F.array_contains(x["head"], ""), whole).otherwise(joined(x["head"]))

    def head(x: Column) -> Column:
        return let(F.struct(x["text"].alias("text"), x["first"].alias("first"), F.transform(F.slice(x["first"], 1, sentences), strip).alias("head")), of)

    return let(F.struct(col.alias("text"), F.split(col, stop, sentences + 1).alias("first")), head)


def plain_markdown(col: Column) -> Column:
    """Without the signs of markdown."""
    return F.regexp_replace(col, r"[#*`\[\]()]", "")


def distinct_ci(values: Column) -> Column:
    """The array's values, collapsed, blanks dropped, the first of those that differ only in case."""
    clean = F.filter(F.transform(values, collapse), lambda x: x != "")
    keys = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def looks_non_english(col: Column) -> Column:
    """German hints, or an umlaut where nothing useful is named."""
    from .. import terms

    return any_of(col, terms.GERMAN_HINTS) | (col.rlike("[äöüß]") & ~any_of(col, (*terms.USEFUL_TERMS, *terms.FAMILIES)) & (pattern_hits(col, terms.SPEC_PATTERNS) == 0))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"^{out}$"


SPECIAL = re.compile(r"[()\[\]^$+?{|\\]")


def matches_any(col: Column, patterns: Iterable[str] | None) -> Column:
    """col matches a shell pattern as a whole or, where the pattern has signs of one, contains a match of the regular expression. Patterns that don't compile are left out."""
    out = F.lit(False)
    for p in patterns or ():
        out = out | col.rlike(glob_regex(p))
        if SPECIAL.search(p):
            try:
                re.compile(p)
            except re.error:
                continue
            out = out | col.rlike(p)
    return out
