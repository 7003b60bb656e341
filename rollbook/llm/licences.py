"""Licence scan with a positional index of rare words: every template is looked up through its rarest word, postings are
intersected by relative position, and key phrases are verified word by word. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and the labels they stand for. The first four are the base.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "free and unencumbered software released into the public domain": "unlicense",
    "under the apache license version 2": "apache-2.0",
    "general public license version 3": "gpl-3.0",
    "general public license version 2": "gpl-2.0",
}
#: Every template holds one of these words; a text with none of them needs no word list.
KEYS = {"license", "cc", "commons", "hereby", "redistribution", "unencumbered"}
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _NOT_WORD), lambda w: w != "")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base (places where a base phrase stands), first_word, last_word
    (smallest and largest start of them), base_labels, labels (sorted, comma-joined), score.

    Words are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased. A template's anchor is its word that
    the fewest documents hold, counted over all of docs. score is 1 with a base phrase, else the longest matched template's
    words over those of the longest template of its label, else 0. Null or empty text: no words, no labels, score 0, null
    places. Rows that share a doc_id, or have none, are judged one by one. Other columns are ignored."""
    phrases = {**BASE, **MORE}
    vocabulary = sorted({w for p in phrases for w in p.split(" ")})
    text = lowered(F.col("text").cast("string"))
    rare = "|".join(sorted({w for p in phrases for w in p.split(" ") if w in KEYS}))
    told = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", words_of(F.col("text")).alias("words"), F.col("text").rlike(f"(?:^|[^0-9a-z\\x{{80}}-\\x{{10FFFF}}])(?:{rare})(?:$|[^0-9a-z\\x{{80}}-\\x{{10FFFF}}])").alias("maybe"))
    told = told.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("maybe"), F.col("words")).alias("words"))

    # how many documents hold each word of the templates
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = told.where("words IS NOT NULL").select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    held = {r["word"]: r["count"] for r in held.collect()}  # at most the words of the templates

    # the index: for each anchor word, the templates it leads to with its place in them
    postings: dict[str, list[tuple[str, int]]] = {}
    for p in phrases:
        parts = p.split(" ")
        at = min(range(len(parts)), key=lambda i: (held.get(parts[i], 0), i))
        postings.setdefault(parts[at], []).append((p, at))
    anchors = F.array(*[F.lit(w) for w in sorted(postings)])
    spot = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda s: F.array_contains(anchors, s["word"]))
    led = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(at).alias("at"), F.lit(phrases[p]).alias("label"), F.lit(p in BASE).alias("base"), F.lit(len(p.split(" "))).alias("size")) for p, at in postings[w]]))])
    # relative positions: a template starts `at` words before its anchor; then the whole phrase is compared
    starts = F.flatten(
        F.transform(
            "spots",
            lambda s: F.transform(
                F.element_at(led, s["word"]),
                lambda t: F.struct((s["pos"] - t["at"]).alias("start"), t["phrase"].alias("phrase"), t["label"].alias("label"), t["base"].alias("base"), t["size"].alias("size")),
            ),
        )
    )
    spotted = told.withColumn("spots", spot)
    places = F.filter(starts, lambda t: (t["start"] >= 0) & (F.array_join(F.slice(F.col("words"), F.greatest(t["start"], F.lit(0)) + 1, t["size"]), " ") == t["phrase"]))
    found = spotted.select("doc_id", "n_words", F.coalesce(places, F.array().cast("array<struct<start:int,phrase:string,label:string,base:boolean,size:int>>")).alias("places"))
    base = F.transform(F.filter("places", lambda t: t["base"]), lambda t: t["start"].cast("long"))
    labels = lambda kept: F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda t: t["label"]))), ",")
    longest: dict[str, int] = {}
    for p, label in phrases.items():
        longest[label] = max(longest.get(label, 0), len(p.split(" ")))
    full = F.create_map(*[x for k, v in sorted(longest.items()) for x in (F.lit(k), F.lit(float(v)))])
    share = F.array_max(F.transform("places", lambda t: t["size"] / F.element_at(full, t["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        labels(F.filter("places", lambda t: t["base"])).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )
