"""License scans as an exact set-similarity join, in DataFrame operations only.

A text block is `2 * S` consecutive words; blocks start every S words, S being the longest template's words, so any S
words in a row lie in one block. A block matches a template where it holds at least `CONTAINMENT` of the template's
distinct words.

1. One pass over the texts splits words, finds the base phrases, and keeps the places of template words in those
   documents that hold enough of some template's words; all others cannot have a matching block.
2. Template words are ordered by the number of documents that hold them, rarest first.
3. Prefix filter: a matching block holds one of the template's first |T| - need + 1 words, so blocks meet templates on
   these words alone. Length filter: the block has at least `need` template words. Positional filter: after the word in
   common, enough words must be left on both sides.
4. Candidates are verified on the whole sets. Templates are a parameter of at most `TEMPLATE_WORDS` words in all, the
   only side that is broadcast.

Null and empty texts have no words and no labels. Repeated rows are scanned each. An empty table gives an empty table.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.llm.shared import staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    *PHRASES,
    ("gpl", "gnu general public license version"),
    ("mpl-2", "mozilla public license version 2"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("epl", "eclipse public license version"),
]
CONTAINMENT = 0.8
TEMPLATE_WORDS = 10_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _needed(size: int) -> int:
    return math.ceil(CONTAINMENT * size - 1e-9)


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels and score (the best containment)."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(body.split()))) for label, body in templates]
    if sum(len(s) for _, s in sets) > TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {TEMPLATE_WORDS} words")
    vocabulary = sorted({w for _, s in sets for w in s} | {w for _, body in phrases for w in body.split()})
    step = max(len(body.split()) for _, body in templates)

    read = docs.select(F.col(key).alias("key"), _words(F.col(text)).alias("words"))
    read = read.withColumn("held", F.array_intersect("words", _literal(vocabulary)))

    def places(body: str) -> Column:
        spelled = body.split()
        holds = F.size(F.array_intersect("held", _literal(spelled))) == len(set(spelled))

        def starts(i: Column) -> Column:
            found = F.get("words", i) == spelled[0]
            for k, w in enumerate(spelled[1:], 1):
                found = found & (F.get("words", i + k) == w)
            return found

        return F.when(holds, F.filter(F.sequence(F.lit(0), F.size("words") - 1), starts)).otherwise(F.array().cast("array<int>"))

    def possible(words: list[str]) -> Column:
        return F.size(F.array_intersect("held", _literal(words))) >= _needed(len(words))

    any_possible = F.lit(False)
    for _, s in sets:
        any_possible = any_possible | possible(s)
    spots = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("held", x["word"]))
    none = F.array().cast("array<struct<word:string,at:int>>")
    first_pass = read.select(
        F.monotonically_increasing_id().alias("row"), "key", F.size("words").cast("long").alias("n_words"), "held",
        F.array(*[F.struct(F.lit(label).alias("label"), places(body).alias("places")) for label, body in phrases]).alias("base"),
        F.when(any_possible, spots).otherwise(none).alias("spots"),
    )
    rows, _ = staged(first_pass, "licenses")

    # rarest words first; at most one row per template word
    counts = {r[0]: r[1] for r in rows.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ranks = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    prefixes = []
    for number, (label, s) in enumerate(sets):
        ordered = sorted(rank[w] for w in s)
        need = _needed(len(ordered))
        prefixes += [(number, label, token, at, ordered, need) for at, token in enumerate(ordered[: len(ordered) - need + 1])]
    probes = spark.createDataFrame(prefixes, "template int, label string, token int, at int, template_tokens array<int>, need int")

    spotted = rows.select("row", F.explode("spots").alias("s")).select("row", F.element_at(ranks, F.col("s.word")).alias("token"), F.floor(F.col("s.at") / step).alias("block"))
    both = spotted.select("row", "token", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    blocks = both.groupBy("row", "block").agg(F.sort_array(F.collect_set("token")).alias("tokens"))  # at most the template words
    met = blocks.select("row", "block", "tokens", F.posexplode("tokens").alias("place", "token")).join(F.broadcast(probes), "token")
    size, left = F.size("tokens"), F.size("tokens") - F.col("place")
    met = met.where((size >= F.col("need")) & (F.least(F.size("template_tokens") - F.col("at"), left) >= F.col("need")))
    overlap = F.size(F.array_intersect("tokens", "template_tokens"))
    matched = met.where(overlap >= F.col("need")).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max(overlap / F.size("template_tokens")).alias("score"))

    base = rows.drop("spots", "held").join(matched, "row", "left")
    all_places = F.flatten(F.transform("base", lambda b: b["places"]))
    base_labels = F.transform(F.filter("base", lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
    labels = F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>")))
    return base.select(
        F.col("key").alias(key), "n_words", F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce("score", F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )
