"""License scans: positional rare-word index over license notices, with DataFrame functions only.

1. The notices' vocabulary is fixed and small. One pass counts in how many texts each of its words
   occurs (combined before the shuffle); that gives every notice word a whole-number inverse-frequency
   weight. A notice is found if words of at least `SHARE` percent of its weight stand in place.
2. The rarest words of a notice that together weigh more than the rest may lack are its anchors: a place
   where all of them are missing cannot reach the share, so looking up anchors alone loses nothing.
3. Each text's anchors give (notice, text position - notice position); equal differences are one
   alignment. Every alignment is scored over all words of the notice, and its span must hold the
   notice's mandatory phrases.

All of this happens inside the text's row; only the word counts are shuffled. Texts without an anchor or
the word `license` skip steps 2 and 3.

Defined cases: null is the empty text: no words, no place, empty labels, score 0; repeated rows and null
ids are kept; an empty table gives an empty result; ties between notices give all their labels; long
texts are scanned whole; only id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Percent of a notice's weight that must stand in place.
SHARE = 80

# Phrases of the base result and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license notices (label, words, mandatory phrases).
NOTICES = (
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ("affero general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "general public license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "associated documentation files")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[str, ...]
    phrases: tuple[str, ...]
    weights: tuple[int, ...]
    anchors: tuple[int, ...]


def words_of(text: Column) -> Column:
    """Words of a text. lower() differs from lower-casing A-Z only on letters that stay inside a word."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def vocabulary(notices=NOTICES) -> list[str]:
    return sorted({w for _, words, _ in notices for w in words.split()})


def notice_index(docs: DataFrame, text: str = "text", notices=NOTICES, share: int = SHARE) -> list[Notice]:
    """Notices with weights and anchors from the word frequencies of all texts."""
    words = vocabulary(notices)
    found = F.array_intersect(words_of(F.col(f"`{text}`")), F.array(*map(F.lit, words)))
    # A marker in every row gives the number of rows from the same pass.
    counts = docs.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}


    total = frequency.pop("", 0)
    weight = {w: 1 + round(1000 * math.log((total + 1) / (frequency.get(w, 0) + 1))) for w in words}
    out = []
    for label, line, phrases in notices:
        own = tuple(line.split())
        weights = tuple(weight[w] for w in own)
        anchors, held = [], 0
        for i in sorted(range(len(own)), key=lambda i: (-weights[i], i)):
            if 100 * held > (100 - share) * sum(weights):
                break
            anchors.append(i)
            held += weights[i]
        out.append(Notice(label, own, tuple(phrases), weights, tuple(anchors)))
    return out


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the phrase, found from its last word."""
    parts = phrase.split()
    back = len(parts) - 1

    def starts(word: Column, at: Column) -> Column:
        same = word == parts[-1]
        for k, part in enumerate(parts[:-1]):
            same = same & (F.get(words, at - (back - k)) == part)
        return F.when(same, (at - back).cast("long"))

    return F.filter(F.transform(words, starts), lambda x: x.isNotNull())


def _alignments(words: Column, index: list[Notice]) -> Column:
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, notice in enumerate(index):
        for i in notice.anchors:
            postings.setdefault(notice.words[i], []).append((t, i))
    table = F.create_map(*[x for w, places in sorted(postings.items()) for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in places]))])
    held = F.filter(
        F.transform(words, lambda w, at: F.struct(F.try_element_at(table, w).alias("places"), at.alias("at"))), lambda x: x["places"].isNotNull())
    return F.array_distinct(F.flatten(F.transform(held, lambda h: F.transform(
        h["places"], lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["i"]).alias("off"))))))


def _score(words: Column, aligned: Column, index: list[Notice]) -> Column:
    """Each alignment with its label, share of the weight in place and whether its phrases stand there."""
    table = F.array(*[
        F.struct(
            F.lit(n.label).alias("label"), _strings(n.words).alias("words"), F.array(*map(F.lit, n.weights)).alias("weights"),
            F.lit(sum(n.weights)).alias("total"), _strings(n.phrases).alias("phrases"))
        for n in index])

    def one(a: Column) -> Column:
        notice = F.get(table, a["t"])
        pairs = F.transform(notice["words"], lambda w, k: F.when(
            (a["off"] + k >= 0) & (F.get(words, a["off"] + k) == w), F.get(notice["weights"], k)).otherwise(F.lit(0)))
        # Before the start of the text the first words of the notice are missing.
        first = F.greatest(a["off"], F.lit(0))
        span = F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, F.size(notice["words"]) + a["off"] - first), " "), F.lit(" "))
        return F.struct(
            notice["label"].alias("label"),
            F.aggregate(pairs, F.lit(0), lambda x, y: x + y).alias("held"), notice["total"].alias("total"),
            F.forall(notice["phrases"], lambda p: F.contains(span, F.concat(F.lit(" "), p, F.lit(" ")))).alias("phrases"))

    return F.transform(aligned, one)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices=NOTICES, share: int = SHARE) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    index = notice_index(docs, text, notices, share)
    anchors = sorted({n.words[i] for n in index for i in n.anchors} | {p.split()[-1] for p, _ in BASE})
    lists = docs.select(F.col(f"`{key}`"), words_of(F.col(f"`{text}`")).alias("w"))
    # The rare rows that may hold anything keep their words; all others only their number.
    rows = lists.select(f"`{key}`", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", _strings(anchors)), F.col("w")).alias("w"))
    none = "array<bigint>"
    for n, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"p{n}", F.coalesce(_phrase_places(F.col("w"), phrase), F.array().cast(none)))
    rows = rows.withColumn("scored", _score(F.col("w"), _alignments(F.col("w"), index), index))
    places = F.concat(*[F.col(f"p{n}") for n in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    good = F.filter("scored", lambda s: (100 * s["held"] >= share * s["total"]) & s["phrases"])
    found = F.coalesce(F.transform(good, lambda s: s["label"]), F.array().cast("array<string>"))
    score = F.coalesce(F.array_max(F.transform("scored", lambda s: s["held"] / s["total"])), F.lit(0.0))
    return rows.select(
        f"`{key}`", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, found))), ",").alias("labels"), score.alias("score"))


def scan_sql(table: str = "documents", notices=NOTICES, share: int = SHARE) -> str:
    """The same result in DuckDB SQL, alignments as joins."""
    rows = ", ".join(
        f"({t}, '{label}', {k}, '{w}')" for t, (label, line, _) in enumerate(notices) for k, w in enumerate(line.split()))
    phrases = ", ".join(f"({t}, '{p}')" for t, (_, _, ps) in enumerate(notices) for p in ps)
    base = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - {len(phrase.split())} AS place FROM base_words WHERE "
        + " AND ".join(f"ws[i - {len(phrase.split()) - 1 - k}] = '{w}'" for k, w in enumerate(phrase.split()))
        for phrase, label in BASE)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM {table}),
n(t, label, k, word) AS (VALUES {rows}),
phrases(t, phrase) AS (VALUES {phrases}),
tok AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
df AS (SELECT word, count(DISTINCT r) AS df FROM tok WHERE word IN (SELECT word FROM n) GROUP BY word),
weighed AS (
  SELECT t, label, k, word, 1 + round(1000 * ln(((SELECT count(*) FROM d) + 1.0) / (coalesce(df, 0) + 1)))::BIGINT AS weight
  FROM n LEFT JOIN df USING (word)),
cum AS (
  SELECT *, sum(weight) OVER (PARTITION BY t) AS total,
         coalesce(sum(weight) OVER (PARTITION BY t ORDER BY weight DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM weighed),
al AS (
  SELECT DISTINCT r, t, i - 1 - k AS off FROM tok JOIN cum USING (word) WHERE 100 * before <= {100 - share} * total),
sc AS (
  SELECT al.r, al.t, al.off, any_value(label) AS label, any_value(total) AS total,
         coalesce(sum(weight) FILTER (off + k >= 0 AND ws[off + k + 1] = word), 0) AS held,
         ' ' || array_to_string(any_value(ws)[greatest(off, 0) + 1 : off + count(*)], ' ') || ' ' AS span
  FROM al JOIN cum USING (t) JOIN d USING (r) GROUP BY al.r, al.t, al.off),
ok AS (
  SELECT * FROM sc WHERE 100 * held >= {share} * total
    AND NOT EXISTS (SELECT 1 FROM phrases p WHERE p.t = sc.t AND NOT contains(sc.span, ' ' || p.phrase || ' '))),
base_words AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
base AS ({base}),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM ok) GROUP BY r),
s AS (SELECT r, max(held / total) AS score FROM sc GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)"""
