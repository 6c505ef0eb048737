"""Scalar text functions as column expressions.  White space is ASCII white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of layout-heavy HTML.
LAYOUT_MARKS = ["<div", "<section", "<article", "<table", "<style", "class=", "tailwind"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncate_chars(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def truncate_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def clean_one_line(c: Column) -> Column:
    return truncate_words(truncate_chars(collapse(strip(c)), 120), 14)


def fallback_one_line(c: Column) -> Column:
    return truncate_words(truncate_chars(collapse(F.substring(strip(c), 1, 600)), 120), 14)


def preview(c: Column, n: int = 120) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("…")))


def stable_id(source: Column, key: Column, hint: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("|"), key, F.lit("|"), F.substring(hint, 1, 80)), 256), 1, 12)


def content_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".png"), "image/png").when(low.endswith(".jpg") | low.endswith(".jpeg"), "image/jpeg").when(low.endswith(".gif"), "image/gif").otherwise("application/octet-stream")


#: Dotted number, closing bracket or none, white space, heading.  "1. Foo" is no heading: a dot must go on with a digit.
NUMBERED = r"^\d+(?:\.\d+)*\)?\s+([\s\S]*)$"


def promoted_heading(c: Column) -> Column:
    """Text of a paragraph that starts like a numbered heading, else null."""
    return F.when(c.rlike(NUMBERED), F.regexp_extract(c, NUMBERED, 1))


def escape_quotes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def elm_string(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(escape_quotes(c), F.lit("\r"), F.lit("")), F.lit("…"), F.lit("...")), F.lit('"'))


def elm_triple(c: Column) -> Column:
    body = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"""'), F.lit('\\"\\"\\"'))
    quotes = F.lit('"""')
    return F.when(body == "", F.lit('""')).when(body.endswith('"'), F.concat(quotes, body, F.lit(" "), quotes)).otherwise(F.concat(quotes, body, quotes))


def time_label(created: Column, updated: Column) -> Column:
    """Of epoch seconds."""
    shown = lambda s: F.date_format(F.timestamp_seconds(s), "yy-MM-dd HH:mm:ss")
    return F.when(created.isNotNull(), shown(created)).when(updated.isNotNull(), F.concat(F.lit("(upd) "), shown(updated))).otherwise(F.lit("(no timestamp)"))


def url_tail(c: Column) -> Column:
    return F.element_at(F.split(c, "/", -1), -1)


def is_complex_html(c: Column) -> Column:
    low, found = F.lower(c), F.length(strip(c)) > 180
    for mark in LAYOUT_MARKS:
        found = found | F.contains(low, F.lit(mark))
    return found


def has_mathml(c: Column) -> Column:
    low = F.lower(c)
    return F.contains(low, F.lit("<math")) | F.contains(low, F.lit("</math"))


def truncate_inline(c: Column) -> Column:
    t = strip(c)
    return F.when(F.length(t) <= 80, t).otherwise(F.concat(F.substring(t, 1, 77), F.lit("…")))


def leading_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"^\d+", 0).try_cast("int")


def document_file_name(title: Column, uid: Column) -> Column:
    return F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit("_"), uid.cast("string"), F.lit(".docx"))


def safe_file_name(name: Column, most: int = 120) -> Column:
    """name without what file systems refuse (separators, control characters); of a long one the end stays."""
    plain = F.regexp_replace(name, r"[/\\\x00-\x1F\x7F]", "_")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most // 2), F.lit("_"), F.substring(plain, -(most - most // 2 - 1), most)))


def month_day(c: Column, as_of: str) -> Column:
    """Date of a text such as "Jan 26", "January 26", "01 26" or "26 01" in the year before as_of's."""
    # the year is put in first: 29 February exists in a leap year only
    last = F.year(F.to_date(F.lit(as_of))) - 1
    leap = lambda pattern: F.try_to_timestamp(F.concat(F.lit("2000 "), c), F.lit(f"yyyy {pattern}"))
    found = F.coalesce(*[leap(p) for p in ("MMM d", "MMMM d", "MM dd", "dd MM")])
    # a day that the year lacks becomes its last day of the month
    day = F.least(F.dayofmonth(found), F.dayofmonth(F.last_day(F.make_date(last, F.month(found), F.lit(1)))))
    return F.make_date(last, F.month(found), day)


#: English stop words of the full-text predicate.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def search_terms(query: str) -> list[str]:
    """Lower-case words of a query but stop words; no stemming."""
    import re

    return sorted({w for w in re.findall(r"[a-z0-9]+", query.lower()) if w not in STOP_WORDS})


def matches_all_terms(text: Column, terms: list[str]) -> Column:
    """Every term is a word of the text; without terms nothing matches."""
    low = F.lower(text)
    found = F.lit(bool(terms))
    for t in terms:  # terms are letters and digits only
        found = found & low.rlike(f"(?<![a-z0-9]){t}(?![a-z0-9])")
    return found


def ordinal_paths(levels: Column) -> Column:
    """The ordinals of headings in a row, from an array of their levels: "1", "1.1", "1.2" for 1, 2, 2.

    A heading keeps the ordinals above its level, as far as there are any, and counts on from its own.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("path"), F.array().cast("array<string>").alias("all"))

    def step(state: Column, level: Column) -> Column:
        own = F.when(F.size(state["path"]) >= level, F.try_element_at(state["path"], level) + 1).otherwise(1)
        path = F.concat(F.slice(state["path"], 1, F.greatest(level - 1, F.lit(0))), F.array(own))
        shown = F.array_join(F.transform(path, lambda x: x.cast("string")), ".")
        return F.struct(path.alias("path"), F.concat(state["all"], F.array(shown)).alias("all"))

    return F.aggregate(levels, start, step, lambda s: s["all"])
