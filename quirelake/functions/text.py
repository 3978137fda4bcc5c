"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
MAX_TOKEN_BYTES = 40


def tokens(text: Column | str) -> Column:
    """Search terms before stemming: runs of letters and digits under 40 bytes, then lower-cased."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), NOT_WORD)
    return F.transform(F.filter(parts, lambda t: (t != "") & (F.octet_length(t) < MAX_TOKEN_BYTES)), F.lower)


def estimate_tokens(text: Column) -> Column:
    """A token for four characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def strip_wikilinks(text: Column) -> Column:
    """``[[note|alias]]`` to the alias, ``[[note]]`` to the note."""
    piped = F.regexp_replace(text, r"\[\[([^\]|]+)\|([^\]]*)\]\]", "$2")
    return F.regexp_replace(piped, r"\[\[([^\]|]+)\]\]", "$1")


def slug(text: Column) -> Column:
    """A heading's address by name."""
    linked = F.when(text.contains("[["), strip_wikilinks(text)).otherwise(text)
    return F.btrim(F.regexp_replace(F.lower(F.translate(linked, "`*_", "")), NOT_WORD, "-"), F.lit("-"))


def resolve_name(target: Column) -> Column:
    """A link target without fragment, folders and one ``.md``."""
    return F.regexp_replace(F.element_at(F.split(F.substring_index(target, "#", 1), "/"), -1), r"\.md$", "")


def decompose(url: Column) -> dict[str, Column]:
    """page, heading and block of a wikilink target."""
    at = F.instr(url, "#")
    rest = F.when(at > 0, url.substr(at + 1, F.length(url)))
    return {
        "page": F.when(at > 0, url.substr(F.lit(1), at - 1)).otherwise(url),
        "heading": F.when((rest != "") & ~rest.startswith("^"), rest),
        "block": F.when(rest.startswith("^"), rest.substr(F.lit(2), F.length(rest))),
    }


def is_numeric_address(address: Column) -> Column:
    return address.rlike(r"^[0-9]+(\.[0-9]+)*$")


def reserved_reading(address: Column) -> Column:
    """text, links, frontmatter or field for the reserved addresses, else null."""
    low = F.lower(address)
    return F.when(low.isin("0", "text"), "text").when(low == "links", "links").when(low.isin("fm", "frontmatter"), "frontmatter").when(low.startswith("fm.") & (F.length(address) > 3) | low.startswith("frontmatter.") & (F.length(address) > 12), "field")


def reserved_path(address: Column) -> Column:
    """The path of a field address, in its own case."""
    return F.when(reserved_reading(address) == "field", F.regexp_replace(address, r"^[^.]*\.", ""))


def truncate_heading(heading: Column) -> Column:
    return F.when(F.length(heading) > 30, F.concat(F.substring(heading, 1, 29), F.lit("…"))).otherwise(heading)


def pad(text: Column, width: int) -> Column:
    """Spaces on the right up to ``width``; longer texts stay whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))))


def tree_line(folded: Column, address: Column, heading: Column, line: Column, lines: Column, tokens_: Column) -> Column:
    depth = F.length(address) - F.length(F.replace(address, F.lit("."), F.lit("")))
    return F.concat(F.when(folded, F.lit("+ ")).otherwise(F.lit("  ")), F.repeat(F.lit("  "), depth), pad(address, 6), F.lit(" "), pad(truncate_heading(heading), 14), F.lit(" L"), line.cast("string"), F.lit("   "), lines.cast("string"), F.lit(" lines · ~"), tokens_.cast("string"), F.lit(" tok"))


def to_lf(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` to ``\\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def escape_whitespace(text: Column) -> Column:
    out = text
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def first_difference_column(a: Column, b: Column) -> Column:
    """The first character, from 1, in which two texts differ; null if they don't."""
    n = F.greatest(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~(F.coalesce(a.substr(i, F.lit(1)), F.lit("")) == F.coalesce(b.substr(i, F.lit(1)), F.lit(""))))
    return F.get(places, F.lit(0))


def opens_link_reference_definition(line: Column) -> Column:
    return line.rlike(r"^ {0,3}\[(?:\\.|[^\[\]\\])+\]:")


def search_body(content: Column) -> Column:
    """The text after a frontmatter block, or all of it; a BOM is dropped."""
    plain = F.regexp_replace(content, "^﻿", "")
    has = plain.rlike(r"(?s)\A[ \t]*---[ \t\r]*\n(?:.*?\n)?[ \t]*---[ \t\r]*(?:\n|\z)")
    return F.when(has, F.regexp_replace(plain, r"(?s)\A[ \t]*---[ \t\r]*\n(?:.*?\n)?[ \t]*---[ \t\r]*(?:\n|\z)", "")).otherwise(plain)
