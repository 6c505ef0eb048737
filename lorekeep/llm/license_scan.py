"""License scans: an exact join of word windows with license templates by the share of a template they hold.

A template is a set of words, and a block is a window of consecutive words of a text, across line
feeds, long enough for the template with a quarter of other words in between (``window_words``).  A
block meets a template if it holds ``LEAST`` of the template's words or more.  Words are ordered by the
number of documents that hold them, rarest first, over the whole corpus; of a template of size s that
needs m common words, a block that meets it holds one of the first s - m + 1 (prefix filter).  So only
the words round such a word are looked at, and only where they hold m of the template's words all
together are their windows verified one by one.  Texts become words once; the words are written
only of a text that as a whole has what a template or phrase needs.

Only DataFrame functions are used.  The templates, a few short sentences, are broadcast as literals.

Cases: null and empty texts have no words, places or labels and score 0; rows with equal ids keep
apart unless their texts are equal too, and then have equal results; ties in word frequency go by the
word; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import Scratch

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Template sentences and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution sharealike license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]
#: Share of a template's words.
LEAST = Fraction(4, 5)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _vocabulary() -> list[str]:
    return sorted({w for t in [*PHRASES, *(t for t, _ in TEMPLATES)] for w in t.split()})


def window_words(template: str) -> int:
    """Words of a block that is compared with a template."""
    return -(-len(template.split()) * LEAST.denominator // LEAST.numerator)


#: Words of the longest block.
_WIDEST = max(window_words(t) for t, _ in TEMPLATES)


def template_rows(spark, frequencies: DataFrame) -> DataFrame:
    """(number, label, token, size, need, place): the words of each template in global order."""
    parts = []
    for number, (text, label) in enumerate(TEMPLATES):
        own = sorted(set(text.split()))
        need = -(-LEAST.numerator * len(own) // LEAST.denominator)
        parts.append(spark.range(1).select(F.lit(number).alias("number"), F.lit(label).alias("label"), F.explode(_array(own)).alias("token"), F.lit(len(own)).alias("size"), F.lit(need).alias("need")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.join(F.broadcast(frequencies), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct("n", "token")))
    sorted_rows = rows.groupBy("number", "label", "size", "need").agg(order.alias("tokens"))
    return sorted_rows.select("number", "label", "size", "need", F.posexplode("tokens").alias("place", "t")).select("number", "label", "size", "need", "place", F.col("t.token").alias("token"), F.col("t.n").alias("n"))


def _starts(parts: list[str]):
    return lambda i: F.slice("words", i + 1, F.lit(len(parts))) == _array(parts)


def _has(own: list[str], least: int | None = None) -> Column:
    """Whether a text has so many of these words, or all of them."""
    return F.size(F.array_intersect("have", _array(own))) >= (len(own) if least is None else least)


def _most_shared(template: str) -> Column:
    """The most words of a template in a block of the words ``near`` that holds the one at ``at``; null if too few are near."""
    own, wide = _array(sorted(set(template.split()))), window_words(template)
    first = F.greatest(F.col("at") - (wide - 1), F.lit(0))
    near = F.slice("near", first + 1, F.col("at") - first + wide)
    blocks = F.transform(F.sequence(first, F.col("at")), lambda i: F.size(F.array_intersect(F.slice("near", i + 1, F.lit(wide)), own)))
    need = -(-LEAST.numerator * len(set(template.split())) // LEAST.denominator)
    return F.when(F.size(F.array_intersect(near, own)) >= need, F.array_max(blocks))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    spark = docs.sparkSession
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)  # A-Z only
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("text"))
    work = Scratch(spark, "license_scan")
    words = source.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    words = words.select("doc_id", "key", "words", F.array_intersect("words", _array(_vocabulary())).alias("have"))
    possible = F.lit(False)
    for template, _ in TEMPLATES:
        own = sorted(set(template.split()))
        possible |= _has(own, -(-LEAST.numerator * len(own) // LEAST.denominator))
    for phrase in PHRASES:
        possible |= _has(sorted(set(phrase.split())))
    words = work.write(words.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "have", F.when(possible, F.col("words")).alias("words")), "words")
    frequencies = words.select(F.explode("have").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    # words round a prefix word of a template; frequencies and templates have a row for each template word
    templates = work.write(template_rows(spark, frequencies), "templates")
    prefix = templates.where(F.col("place") <= F.col("size") - F.col("need")).select("number", "label", "size", "need", "token")
    rare = sorted({r.token for r in prefix.select("token").distinct().collect()})
    hits = words.where(F.arrays_overlap("words", _array(rare))).select("doc_id", "key", "words", F.posexplode("words").alias("at", "token")).where(F.col("token").isin(rare))
    begin = F.greatest(F.col("at") - (_WIDEST - 1), F.lit(0))
    hits = hits.select("doc_id", "key", "token", (F.col("at") - begin).alias("at"), F.slice("words", begin + 1, F.col("at") - begin + _WIDEST).alias("near"))
    of = F.lit(None)
    for n, (template, _) in enumerate(TEMPLATES):
        of = F.when(F.col("number") == n, _most_shared(template)).otherwise(of)
    found = hits.join(F.broadcast(prefix), "token").withColumn("shared", of).where(F.col("shared") >= F.col("need"))
    found = found.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))

    places, labels = F.array().cast("array<int>"), F.array().cast("array<string>")
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        maybe = _has(sorted(set(parts)))
        at = F.filter(F.sequence(F.lit(0), F.size("words")), _starts(parts))
        own = F.when(maybe, at).otherwise(F.array().cast("array<int>"))
        places = F.concat(places, own)
        labels = F.concat(labels, F.when(F.size(own) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")))
    rows = words.select("doc_id", "key", "n_words", places.alias("places"), labels.alias("base"))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("r.doc_id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
