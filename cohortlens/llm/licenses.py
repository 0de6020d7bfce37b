"""Licence scans by a positional index of rare words.

A template is the notice of a licence, with a key phrase that must stand in a text
whole. The index maps one word of each key phrase, the one that fewest documents hold
(the highest IDF), to the templates and places it has there. Of a text, only the
places of such words are looked up; a posting moved by its place in the template
says where the template would begin, and postings that say the same are one candidate.
A candidate counts if all words of its key phrase stand at their places; its weight is the
share of the template's IDF that stands in place. Every place of a key phrase holds
its rarest word, so none is missed, whatever the counts are.

How it runs: one pass counts the documents of each licence word (one row a word,
partial sums before the shuffle), then a text's lookup is one projection of array
functions, without shuffle, join or Python. The index is a literal, as large as the templates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``notice`` holds ``key`` once; both are words between single spaces."""
    label: str
    key: str
    notice: str

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i:i + len(key)] == key)


# Usual notices of public licences. The first three keys are the base phrases.
TEMPLATES = (
    Template("mit", "under the mit license", "released under the mit license"),
    Template("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("mit", "permission is hereby granted free of charge",
             "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2", "you may not use this file except in compliance with the license",
             "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("agpl-3", "gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms",
             "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    Template("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    Template("cc-by-nc-nd", "cc by nc nd", "licensed under cc by nc nd 4 0"),
    Template("cc-by-nc-sa", "cc by nc sa", "licensed under cc by nc sa 4 0"),
    Template("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc0", "cc0 1 0 universal", "creative commons cc0 1 0 universal public domain dedication"),
    Template("gpl-2", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software",
             "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl-2-1", "gnu lesser general public license version 2 1", "under the gnu lesser general public license version 2 1"),
    Template("lgpl-3", "gnu lesser general public license version 3", "under the gnu lesser general public license version 3"),
    Template("mpl-2", "mozilla public license v 2 0", "subject to the terms of the mozilla public license v 2 0"),
    Template("mpl-2", "mozilla public license version 2 0", "licensed under the mozilla public license version 2 0"),
    Template("unlicense", "free and unencumbered software released into the public domain",
             "this is free and unencumbered software released into the public domain"),
)
BASE = 3


def words_of(text: Column) -> Column:
    """The words of a text (null: none), in order."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, NO_WORD), lambda w: w != "")


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the words of ``text`` in column ``name``, made once a row: as what a
    generator gives, they are not worked out again by each use of them."""
    return df.select("*", F.inline(F.array(F.struct(words_of(F.col(f"`{text}`")).alias(name)))))


def inverse_frequencies(df: DataFrame, text: str, words: list[str]) -> dict[str, float]:
    """ln((1 + N) / (1 + documents that hold the word)) + 1 over all rows of ``df``; a word
    that none holds has the largest."""
    held = F.array_distinct(F.filter(words_of(F.col(f"`{text}`")), lambda w: w.isin(words)))
    # the null marks a row, so that the rows are counted in the same pass
    counts = {r["word"]: r["n"] for r in df.select(F.explode(F.concat(held, F.array(F.lit(None).cast("string")))).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: math.log((1 + counts.get(None, 0)) / (1 + counts.get(w, 0))) + 1 for w in words}


def scan_licenses(df: DataFrame, text: str, templates: tuple[Template, ...] = TEMPLATES, found: str = "found",
                  n_words: str = "n_words") -> DataFrame:
    """``df`` with ``n_words`` (long) and ``found``, an array of (template, label, start, weight):
    every place of a key phrase, by template and place; ``start`` is the place of its first word.

    A null text has no words. Whole texts of any length. Columns of ``df`` named like the two
    new ones are replaced; rows and other columns stay as they are, and an empty table stays empty.
    """
    df = df.drop(found, n_words)
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = inverse_frequencies(df, text, vocabulary)
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        key = t.key.split()
        rare = max(key, key=lambda w: (idf[w], w))
        for i in range(len(key)):
            if key[i] == rare:
                postings.setdefault(rare, []).append((k, i))
    rare, many = sorted(postings), len(templates)

    def looked_up(words: Column) -> Column:
        """Candidates of the rare words' places, as one number each: the start of the key
        phrase times the number of templates, plus the template."""
        at = F.when(F.arrays_overlap(words, F.array(*map(F.lit, rare))),
                    F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), F.isnotnull))
        index = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in postings[w]]))])
        moved = F.transform(at, lambda p: F.transform(index[p["w"]], lambda q: (p["i"] - q["i"]).cast("long") * many + q["k"]))
        return F.array_distinct(F.flatten(moved))

    def weight(words: Column, k: int, start: Column) -> Column:
        """Share of a template's IDF that stands in place; null if its key phrase does not stand whole."""
        t = templates[k]
        place = lambda i: F.get(words, start + (i - t.key_at))
        inside = range(t.key_at, t.key_at + len(t.key.split()))
        whole = F.lit(True)
        for i in inside:
            whole = whole & F.coalesce(place(i) == t.words[i], F.lit(False))
        share = F.lit(sum(idf[t.words[i]] for i in inside))
        for i, w in enumerate(t.words):
            if i not in inside:
                share = share + F.when(place(i) == w, idf[w]).otherwise(0.0)
        return F.when(whole, F.least(share / sum(idf[w] for w in t.words), F.lit(1.0)))

    def verified(words: Column, candidates: Column) -> Column:
        def judged(c: Column) -> Column:
            template, share = F.pmod(c, F.lit(many)).cast("int"), F.lit(None).cast("double")
            start = F.floor((c - template) / many).cast("int")
            for k in reversed(range(many)):
                share = F.when(template == k, weight(words, k, start)).otherwise(share)
            label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), template + 1)
            return F.struct(template.alias("template"), label.alias("label"), start.cast("long").alias("start"), share.alias("weight"))
        return F.filter(F.transform(candidates, judged), lambda f: f["weight"].isNotNull())

    split = with_words(df, text, "_licence_words")
    # a second generator, so that the candidates too are worked out once
    placed = split.select("*", F.inline(F.array(F.struct(looked_up(F.col("_licence_words")).alias("_licence_places")))))
    none = F.array().cast("array<struct<template int, label string, start long, weight double>>")
    return (placed.withColumn(n_words, F.size("_licence_words").cast("long"))
            .withColumn(found, F.coalesce(F.array_sort(verified(F.col("_licence_words"), F.col("_licence_places"))), none))
            .drop("_licence_words", "_licence_places"))


def label_list(found: Column) -> Column:
    """Labels of an array of finds: distinct, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def scan_sql(documents: str = "documents", templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The whole scan in SQL, without the index: each key phrase is sought at every word."""
    rows = ",\n".join(f"({k}, '{t.label}', {t.key_at}, {len(t.key.split())}, string_split('{t.notice}', ' '))" for k, t in enumerate(templates))
    return f"""
WITH t(template, label, key_at, key_n, words) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM {documents}),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM t),
held AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT r, unnest(words) AS word FROM d) JOIN vocabulary USING (word) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1 AS idf FROM vocabulary LEFT JOIN held USING (word)),
parts AS (SELECT template, label, key_at, key_n, u.i AS i, words[u.i] AS word, idf FROM t, unnest(range(1, len(words) + 1)) AS u(i), idf WHERE idf.word = words[u.i]),
places AS (SELECT r, i, words[i] AS word FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d) WHERE words[i] IN (SELECT word FROM vocabulary)),
aligned AS (SELECT r, template, places.i - parts.i + key_at AS start, sum(idf) AS weight,
    count(*) FILTER (parts.i BETWEEN key_at + 1 AND key_at + key_n) AS in_key, any_value(key_n) AS key_n, any_value(label) AS label
  FROM places JOIN parts USING (word) GROUP BY 1, 2, 3),
found AS (SELECT r, template, label, start, weight / total AS weight FROM aligned
  JOIN (SELECT template, sum(idf) AS total FROM parts GROUP BY 1) USING (template) WHERE in_key = key_n),
scanned AS (SELECT r, count(*) FILTER (template < {BASE}) AS n_base, min(start) FILTER (template < {BASE}) AS first_word,
    max(start) FILTER (template < {BASE}) AS last_word, max(weight) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {BASE}) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1), 6) AS score
FROM d LEFT JOIN scanned USING (r)
"""
