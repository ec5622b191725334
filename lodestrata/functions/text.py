"""Column expressions for Markdown cleaning, lines, titles and paths; all run in the JVM but title case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.config import STUB_CHARS

#: What ends a line (Python's rule), and Unicode white space for trimming.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
WRAPPERS = ["alert", "panel", "details", "card"]
#: Patterns of links and shortcodes, and what some shortcodes mean.
LINK = r"\[([^\]]+)\]\([^)]+\)"
INCLUDE = r'\{\{%\s*include\s+"[^"]+"\s*%\}\}'
YES = r"\{\{<\s*yes\s*>\}\}"
NO = r"\{\{<\s*no\s*>\}\}"
LABEL = r'\{\{<\s*label\s+name="([^"]+)"[^>]*>\}\}'
WRAPPER = r"\{\{%\s*/?NAME\b[^%]*%\}\}"
SHORTCODE = r"(?s)\{\{[%<].*?[%>]\}\}"
BLANK_LINES = r"\n{3,}"


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim() takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a last, empty one is not a line."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def delinked(c: Column) -> Column:
    return F.regexp_replace(c, LINK, "$1")


def included(c: Column, includes: Column | None = None) -> Column:
    """Include shortcodes, each replaced once by includes[rel] (a map column) or a mark."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({INCLUDE})"), F.lit(1)))
    rel = lambda m: F.regexp_extract(m, r'"([^"]+)"', 1)
    text = lambda m: F.coalesce(includes[rel(m)], F.concat(F.lit("[included: "), rel(m), F.lit("]"))) if includes is not None else F.concat(F.lit("[included: "), rel(m), F.lit("]"))
    # split at the shortcodes and put the texts between, so that what is put in is not looked at again
    between = F.split(c, INCLUDE)
    every = F.regexp_extract_all(c, F.lit(f"({INCLUDE})"), F.lit(1))
    put = F.concat(F.transform(every, text), F.array(F.lit("")))
    return F.when(F.size(found) == 0, c).otherwise(F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, b)), ""))


def without_shortcodes(c: Column, includes: Column | None = None) -> Column:
    """Includes, then the shortcodes that mean a text, then wrappers, then all others; blank lines collapse."""
    out = included(c, includes)
    out = F.regexp_replace(out, YES, "Yes")
    out = F.regexp_replace(out, NO, "No")
    out = F.regexp_replace(out, LABEL, r"\[$1\]")
    for tag in WRAPPERS:
        out = F.regexp_replace(out, WRAPPER.replace("NAME", tag), "")
    # all of them begin with two braces, which few texts have
    out = F.when(c.contains("{{"), F.regexp_replace(out, SHORTCODE, "")).otherwise(c)
    return strip(F.regexp_replace(out, BLANK_LINES, "\n\n"))


def prose_chars(body: Column) -> Column:
    """Characters of lines that are neither blank nor bullets nor shortcodes, links taken as their texts."""
    prose = F.filter(lines(delinked(body)), lambda x: (strip(x) != "") & ~F.substring(strip(x), 1, 1).isin("-", "*", "{"))
    return F.aggregate(F.transform(prose, lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)


def is_stub(body: Column) -> Column:
    return prose_chars(body) < STUB_CHARS


def title_case(c: Column) -> Column:
    """Every run of letters capitalised, digits and marks ending a run (initcap only looks at blanks)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def title_from_path(path: Column) -> Column:
    """The file's stem, or for _index.md its folder, as a title."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    name = F.when((stem == "_index") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(stem)
    return title_case(F.translate(name, "-_", "  "))


def resolved_title(given: Column, heading_paths: Column, path: Column) -> Column:
    """The title given; else the first heading path of length one; else from the path. heading_paths: array of arrays."""
    first = F.get(F.filter(heading_paths, lambda h: F.size(h) == 1), 0)
    return F.coalesce(F.when(given != "", given), F.get(first, 0), title_from_path(path))


def folder_of(relative: Column) -> Column:
    return F.split(relative, "/")[0]


def in_hidden_folder(relative: Column) -> Column:
    """Whether a folder below the first is hidden or private; file names are not looked at."""
    parts = F.split(relative, "/")
    return F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p.startswith(".") | p.startswith("_"))


def common_prefix(paths: Column) -> Column:
    """The longest shared prefix of an array of arrays of strings."""
    shared = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x == y, x)), F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("go")),
        lambda acc, x: F.when(acc["go"] & x.isNotNull(), F.struct(F.concat(acc["p"], F.array(x)).alias("p"), F.lit(True).alias("go"))).otherwise(F.struct(acc["p"].alias("p"), F.lit(False).alias("go"))),
        lambda acc: acc["p"],
    )
    return F.coalesce(F.aggregate(F.slice(paths, 2, 1 << 30), F.get(paths, 0), shared), F.array().cast("array<string>"))


def truncated(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
