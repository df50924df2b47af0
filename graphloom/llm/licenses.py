"""Licence scans by a positional rare-token index (operator 5). DataFrame functions only.

Templates are licence notices as words. Each template is looked up by the word of its key phrase with the highest
inverse document frequency (counted over all files): every place of that word proposes where the template would
begin. No verified template is without that word, so none is lost, however many notices a file holds. Proposals are
verified in place: the template's words found at their positions must hold enough of its total weight, and all words
of its mandatory key phrase must be there.
Fixed phrases (BASE) are found wherever their words stand one after another.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice, mandatory key phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0-1.0", "released under creative commons zero cc0 1 0 universal", "cc0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
LEAST_SHARE = 0.6
_VOCABULARY = sorted({w for x in (*BASE, *(t for _, t, _ in TEMPLATES)) for w in x.split()})
#: A text without any of these has neither a base phrase nor a key phrase.
_ANCHORS = sorted({p.split()[0] for p in BASE} - {"all", "general"} | {"reserved", "license", "apache", "redistribution", "cc", "cc0", "gnu", "hereby", "mozilla", "unencumbered"})


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _literals(values) -> Column:
    return F.array(*map(F.lit, values))


def _places(words: Column, phrase: str, label: str) -> Column:
    """Where the phrase's words begin, with its label."""
    first, *rest = phrase.split()

    def place(w: Column, i: Column) -> Column:
        here = w == first
        for k, x in enumerate(rest, 1):
            here = here & F.coalesce(F.get(words, i + k) == x, F.lit(False))
        return F.when(here, i.cast("long"))

    return F.transform(F.filter(F.transform(words, place), lambda p: p.isNotNull()), lambda at: F.struct(F.lit(label).alias("label"), at.alias("at")))


def _key_at(notice: list[str], key: list[str]) -> int:
    return next(k for k in range(len(notice)) if notice[k : k + len(key)] == key)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, n_words, base_places, base_labels, found, score), one row per row of docs.

    base_places: array<struct<label, at>>; found: array<struct<label, at, share>> of verified templates, at the
    number of the first word from 0; base_labels: distinct and sorted. score: 1 with a base phrase, else the best share
    of a verified template, else 0. Null and empty texts have no words. Repeated rows give repeated results;
    an empty table gives an empty result.
    """
    split = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    seen = split.withColumn("seen", F.array_intersect("words", _literals(_VOCABULARY)))
    rows = staged(seen.select("id", F.size("words").cast("long").alias("n_words"), "seen", F.when(F.arrays_overlap("seen", _literals(_ANCHORS)), F.col("words")).alias("words")), "licences")

    # at most one row per word of the templates
    counts = {r.word: r.n for r in rows.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = rows.count()
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in _VOCABULARY}
    words = F.col("words")
    postings: dict[str, list[int]] = {}
    for t, (_, notice, key) in enumerate(TEMPLATES):
        own, phrase = notice.split(), key.split()
        rarest = max(phrase, key=lambda w: (idf[w], w))
        postings.setdefault(rarest, []).append((t << 32) - _key_at(own, phrase) - phrase.index(rarest))
    # a proposal is one number: the template, and from where it would begin (which may be before the text)
    table = F.create_map(*chain.from_iterable((F.lit(w), F.array(*(F.lit(p).cast("long") for p in ps))) for w, ps in sorted(postings.items())))
    shift = 1 << 31
    proposed = F.array_distinct(F.flatten(F.filter(F.transform(words, lambda w, i: F.when(w.isin(*postings), F.transform(F.element_at(F.col("postings"), w), lambda p: p + i + shift))), lambda x: x.isNotNull())))
    weighted = []
    for _, notice, key in TEMPLATES:
        own, phrase = notice.split(), key.split()
        at = _key_at(own, phrase)
        whole = sum(idf[w] for w in own)
        weighted.append(F.array(*(F.struct(F.lit(w).alias("word"), F.lit(idf[w] / whole).alias("share"), F.lit(at <= k < at + len(phrase)).alias("key")) for k, w in enumerate(own))))
    labels = _literals([label for label, _, _ in TEMPLATES])

    def verified(p: Column) -> Column:
        t, begin = F.shiftright(p, 32).cast("int"), (p.bitwiseAND(F.lit((1 << 32) - 1)) - shift).cast("int")
        own = F.transform(F.get(F.col("templates"), t), lambda x, k: F.struct(x.share.alias("share"), x.key.alias("key"), F.coalesce(F.get(words, begin + k) == x.word, F.lit(False)).alias("here")))
        share = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + F.when(x.here, x.share).otherwise(0.0))
        return F.when(F.forall(own, lambda x: x.here | ~x.key), F.struct(F.get(labels, t).alias("label"), begin.cast("long").alias("at"), F.least(share, F.lit(1.0)).alias("share")))

    held = rows.withColumn("postings", table).withColumn("templates", F.array(*weighted))
    found = held.withColumn("proposed", proposed).withColumn("found", F.filter(F.transform("proposed", verified), lambda x: x.isNotNull() & (x.share >= least_share)))
    base = F.concat(*(_places(words, phrase, label) for phrase, label in BASE.items()))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    out = found.select("id", "n_words", none(base, "array<struct<label: string, at: long>>").alias("base_places"), none(F.col("found"), "array<struct<label: string, at: long, share: double>>").alias("found"))
    score = F.when(F.size("base_places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0)))
    return out.select("id", "n_words", "base_places", F.array_sort(F.array_distinct("base_places.label")).alias("base_labels"), "found", score.alias("score"))


def _rows(values) -> str:
    return ", ".join(f"({', '.join(map(repr, v))})" for v in values)


_NOTICE_WORDS = [(label, k, w, int(_key_at(n.split(), key.split()) <= k < _key_at(n.split(), key.split()) + len(key.split()))) for label, n, key in TEMPLATES for k, w in enumerate(n.split())]
_PHRASES = [(label, *(p.split() + [""])[:3]) for p, label in BASE.items()]

#: The digest's rows (queries.license_digest) in DuckDB SQL, over words as rows.
SQL = rf"""
WITH split AS (SELECT row_number() OVER () AS file, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
notice(label, k, word, is_key) AS (VALUES {_rows(_NOTICE_WORDS)}),
phrase(label, first, second, third) AS (VALUES {_rows(_PHRASES)}),
vocabulary(word) AS (VALUES {_rows((w,) for w in _VOCABULARY)}),
placed AS (SELECT file, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM split),
known AS (SELECT placed.* FROM placed JOIN vocabulary USING (word)),
frequency AS (SELECT word, count(DISTINCT file) AS n FROM vocabulary LEFT JOIN known USING (word) GROUP BY word),
idf AS (SELECT word, ln((SELECT count(*) + 1.0::DOUBLE FROM split) / (n + 1)) + 1e-9::DOUBLE AS idf FROM frequency),
weighted AS (SELECT label, k, word, is_key, idf / sum(idf) OVER (PARTITION BY label) AS share FROM notice JOIN idf USING (word)),
proposed AS (SELECT DISTINCT known.file, label, place - k AS begins FROM known JOIN notice ON notice.word = known.word),
verified AS (SELECT p.file, p.label, p.begins, sum(CASE WHEN known.word IS NULL THEN 0 ELSE share END) AS share FROM proposed p JOIN weighted t ON t.label = p.label
    LEFT JOIN known ON known.file = p.file AND known.place = p.begins + t.k AND known.word = t.word GROUP BY ALL HAVING bool_and(known.word IS NOT NULL OR is_key = 0)),
found AS (SELECT * FROM verified WHERE share >= {LEAST_SHARE}),
ahead AS (SELECT file, place, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM placed WINDOW o AS (PARTITION BY file ORDER BY place)),
base AS (SELECT file, place, label FROM ahead JOIN phrase ON word = first AND ahead.second = phrase.second AND (phrase.third = '' OR ahead.third = phrase.third)),
places AS (SELECT file, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY file),
every AS (SELECT file, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT file, label FROM base UNION ALL SELECT file, label FROM found) GROUP BY file),
best AS (SELECT file, max(least(share, 1)) AS share FROM found GROUP BY file)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(coalesce(share, 0.0::DOUBLE), 9) END AS score
FROM split LEFT JOIN places USING (file) LEFT JOIN every USING (file) LEFT JOIN best USING (file)
"""
