"""String helpers shared by the log, source and response functions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(literal: str) -> str:
    """Escape a literal for a Java regular expression."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def count_of(text: Column, literal: str) -> Column:
    """How often ``literal`` occurs."""
    gone = F.replace(text, F.lit(literal), F.lit(""))
    removed = F.length(text) - F.length(gone)
    return removed if len(literal) == 1 else F.floor(removed / F.lit(len(literal))).cast("int")


def contains_all(text: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(m)) for m in markers])


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def after_first(text: Column, marker: str) -> Column:
    """Text after the first marker; null when the marker is absent."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.substring(text, at + F.lit(len(marker)), F.length(text)))


def after_last(text: Column, marker: str) -> Column:
    """Text after the last marker, or the whole text."""
    return F.substring_index(text, marker, -1)


def last_segment(text: Column, sep: str = "/") -> Column:
    """Project name of a URL, file name of a path, method of a dotted name."""
    return F.substring_index(text, sep, -1)


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def replace_last(text: Column, what: str, new: str) -> Column:
    """Replace the last ``what``.  Without one the result is ``new + text``."""
    tail = F.substring_index(text, what, -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail) - F.lit(len(what)))
    return F.when(F.contains(text, F.lit(what)), F.concat(head, F.lit(new), tail)).otherwise(
        F.concat(F.lit(new), text)
    )


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_message(message: Column, kind: Column) -> Column:
    """A report message: its text, else its type, on one line."""
    return squeeze(F.coalesce(message, kind))


def strip_marker(line: Column, marker: str) -> Column:
    """Remove a marker wherever it occurs and trim."""
    return F.btrim(F.replace(line, F.lit(marker), F.lit("")), F.lit(" \t\r\n"))


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\f"))


def drop_all(text: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("")), markers, text)


def swap_all(text: Column, markers: Sequence[str], new: str) -> Column:
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit(new)), markers, text)


def region_between(text: Column, start: str, end: str, noise: Sequence[str] = ()) -> Column:
    """Text after the last ``start`` and before the first ``end`` that follows."""
    return drop_all(F.substring_index(F.substring_index(text, start, -1), end, 1), noise)


def delimited_block(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Block of the first (start, end) rule whose markers are both present."""
    arms = [
        F.when(
            contains_all(text, pair),
            F.substring_index(after_first(text, pair[0]), pair[1], 1),
        )
        for pair in rules
    ]
    return F.coalesce(*arms)


def span_slice(text: Column, start_line: Column, end_line: Column) -> Column:
    """Whole lines ``start_line..end_line``, 1-based, both included.

    Line ends are kept, so the spans of a text concatenate to the text.  No
    start gives an empty string.  No end means up to the end of the text, cut
    before the last ``}`` if there is exactly one more ``}`` than ``{``.
    """

    def cut(all_lines: Column, start: Column, count: Column) -> Column:
        picked = F.array_join(F.slice(all_lines, start, count), "\n")
        at_end = start + count > F.size(all_lines)
        return F.concat(picked, F.when(at_end, F.lit("")).otherwise(F.lit("\n")))

    def open_end(piece: Column) -> Column:
        surplus = count_of(piece, "}") - count_of(piece, "{")
        keep = F.length(piece) - F.length(F.substring_index(piece, "}", -1)) - 1
        return F.when(surplus == 1, F.substring(piece, F.lit(1), keep)).otherwise(piece)

    def pick(s: Column) -> Column:
        begin = F.greatest(s["start"], F.lit(1))
        return (
            F.when(s["start"].isNull(), F.lit(""))
            .when(begin > F.size(s["lines"]), F.lit(""))
            .when(s["end"].isNull(), let(cut(s["lines"], begin, F.size(s["lines"])), open_end))
            .otherwise(cut(s["lines"], begin, F.greatest(s["end"] - begin + 1, F.lit(0))))
        )

    # bound once: callers pass computed positions
    bound = F.struct(
        lines(text).alias("lines"), start_line.alias("start"), end_line.alias("end")
    )
    return let(bound, pick)


def line_at(text_lines: Column, number: Column) -> Column:
    """Trimmed line; null outside 1..n."""
    return F.when(number > 0, trim_ws(F.try_element_at(text_lines, number)))


def ordered_distinct(values: Column) -> Column:
    """Distinct non-null values in order of first occurrence."""
    return F.array_distinct(F.array_compact(values))


def union_messages(first: Column, second: Column) -> Column:
    return ordered_distinct(F.concat(first, second))


def joined(values: Column) -> Column:
    return F.array_join(values, "\n")


def plain_path(path: Column) -> Column:
    """A path without scheme and authority, percent-decoded if it was a URI."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    return F.when(bare != path, F.coalesce(decoded, bare)).otherwise(path)
