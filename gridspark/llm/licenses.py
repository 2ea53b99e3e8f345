"""License scans by diagonal voting: k-gram hits on templates, counted along diagonals, merged, verified.

Every rolling k-gram of the words of every text is hashed on the workers; those whose hash occurs in a template (the
template hashes are a small constant set, so nothing else can join) go on, the words compared first. Hits are Spark-joined
to the template positions and counted per (text, template, diagonal), a diagonal being place in the text minus place in
the template. Spans come from two mergers of hits: diagonals at most `SLACK` apart, and hits that follow each other in the
text and in the template with a gap of at most the template's length, so a long insertion does not split a match. A span is
verified: its hits must cover at least `COVER` of the template's words and, in place, every word of `REQUIRED` in it; no word
of `ABSENT` may stand in the span or right behind it, and none of `CHANGES` among the words inserted into it, whatever the label (a
span inside such a changed one of the same template goes with it).
The score is the number of template words covered over the template's length plus the inserted words: insertions lower it, but
harmless ones (a page header) do not take the label away.

Base labels come from short fixed phrases found in the same scan. Defined cases: a null text has no words; repeated rows get
a row each; no match gives empty labels, null places and score 0; a base phrase scores 1; other columns are ignored; an empty
table gives an empty result. Texts equal to each other are voted on once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import join_spread, row_key, written
from gridspark.llm.textvec import ALNUM_WORDS, Texts, gram_hash, slices

GRAM = 4
SLACK = 3
COVER = 0.6
#: Phrases of the base labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Openings of public licenses and the usual notices, lower-cased words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
            "furnished to do so"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
                 "licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
              "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non commercial 4 0 international license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: By label, the words that tell a license from its neighbours, and the words that make it another one.
REQUIRED = {"mit": ["mit"], "apache-2": ["2"], "gpl-3": ["3"], "cc-by-nc": ["nc", "noncommercial", "commercial"], "mpl-2": ["2"]}
ABSENT = {"gpl-3": ["lesser", "affero"], "cc-by-nc": ["sa", "nd", "sharealike", "noderivatives", "noderivs"]}

#: Words that change the terms when they are inserted into a license, for every label.
CHANGES = ["not", "non", "noncommercial", "nonprofit", "academic", "prohibited"]


def _grams(texts: list[str], k: int) -> dict[int, list[bytes]]:
    out = {}
    for text in texts:
        words = text.encode().split()
        for i in range(len(words) - k + 1):
            out[gram_hash(words[i:i + k])] = words[i:i + k]
    return out


def _hits(docs: DataFrame, templates: list, phrases: list, gram: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = _grams([t for _, t in templates], gram)
    known = np.sort(np.array(list(wanted), np.uint64))
    named = [(label, p.encode().split()) for label, p in phrases]
    barred = {w.encode(): gram_hash([w.encode()]) for x in (*ABSENT.values(), CHANGES) for w in x}
    stops_type = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int64())]))
    hits_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words = Texts.of(part.column("t")).words(ALNUM_WORDS, lower=True)
                size = part.num_rows
                hits, places, labels = [[] for _ in range(size)], [[] for _ in range(size)], [set() for _ in range(size)]
                stops = [[] for _ in range(size)]

                def same(i: int, text: list[bytes], words=words) -> bool:
                    return all(words.text(i + j) == w for j, w in enumerate(text))

                at, h = words.grams(gram)
                found = np.flatnonzero(np.isin(h, known))
                for i, value in zip(at[found].tolist(), h[found].tolist(), strict=True):
                    if same(i, wanted[value]):
                        row = int(words.row[i])
                        hits[row].append({"hash": int(np.uint64(value).view(np.int64)), "at": i - int(words.first[row])})
                at, h = words.grams(1)
                for word, value in barred.items():
                    for i in at[h == np.uint64(value)].tolist():
                        row = int(words.row[i])
                        if hits[row] and same(i, [word]):
                            stops[row].append({"word": word.decode(), "at": i - int(words.first[row])})
                for label, text in named:
                    at, h = words.grams(len(text))
                    for i in at[h == np.uint64(gram_hash(text))].tolist():
                        if same(i, text):
                            row = int(words.row[i])
                            places[row].append(i - int(words.first[row]))
                            labels[row].add(label)
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), part.column("key"), pa.array(words.per_row), pa.array([len(p) for p in places], pa.int64()),
                     pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                     pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(hits, hits_type),
                     pa.array(stops, stops_type)],
                    ["i", "key", "n_words", "n_base", "first_word", "last_word", "base", "hits", "stops"])

    part = docs.select(F.col(id_col).alias("i"), row_key(text_col).alias("key"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(rows, f"i {kind}, key string, n_words long, n_base long, first_word long, last_word long, base array<string>, "
                                 "hits array<struct<hash:bigint,at:bigint>>, stops array<struct<word:string,at:bigint>>")


def spans(scanned: DataFrame, templates: list, gram: int, slack: int, cover: float) -> DataFrame:
    """key, template, label, start, end, score of every verified span."""
    spark = scanned.sparkSession
    places = [(int(np.uint64(gram_hash(w[i:i + gram])).view(np.int64)), n, label, i, len(w))
              for n, (label, t) in enumerate(templates) for w in [t.encode().split()] for i in range(len(w) - gram + 1)]
    positions = spark.createDataFrame(places, "hash long, template int, label string, place int, length int")
    once = scanned.filter(F.size("hits") > 0).groupBy("key").agg(F.first("hits").alias("hits"), F.first("stops").alias("stops"))
    hits = once.select("key", F.explode("hits").alias("x")).select("key", "x.hash", "x.at").join(positions, "hash") \
        .withColumn("diagonal", F.col("at") - F.col("place"))
    votes = hits.groupBy("key", "template", "label", "length", "diagonal").agg(
        F.collect_set("place").alias("places"), F.collect_set("at").alias("ats"), F.min("at").alias("low"), (F.max("at") + gram).alias("high"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True)).cast("int")
    merged = votes.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(order)) \
        .groupBy("key", "template", "label", "length", "cluster").agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
            F.min("low").alias("start"), F.max("high").alias("end"))
    # hits in the order of the text; a new chain starts where the template's order breaks or the gap outgrows the template
    walk = Window.partitionBy("key", "template").orderBy("at", "place")
    broken = (F.col("place") <= F.lag("place").over(walk)) | (F.col("at") - F.lag("at").over(walk) - gram > F.col("length"))
    chained = hits.withColumn("apart", F.coalesce(broken, F.lit(True)).cast("int")).withColumn("cluster", F.sum("apart").over(walk)) \
        .groupBy("key", "template", "label", "length", "cluster").agg(
            F.collect_set("place").alias("places"), F.collect_set("at").alias("ats"), F.min("at").alias("start"), (F.max("at") + gram).alias("end"))

    def words_of(starts: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + gram - 1))))

    need = F.array(*(F.array(*(F.lit(k) for k, w in enumerate(t.split()) if w in REQUIRED.get(label, []))).cast("array<int>") for label, t in templates))
    barred = F.array(*(F.array(*map(F.lit, ABSENT.get(label, []))).cast("array<string>") for label, _ in templates))
    found = merged.unionByName(chained).withColumn("covered", words_of("places")) \
        .filter((F.size("covered") / F.col("length") >= cover) & (F.size(F.array_except(F.get(need, F.col("template")), F.col("covered").cast("array<int>"))) == 0))
    stopped = F.exists("stops", lambda x: x["at"].between(F.col("start"), F.col("end")) & F.array_contains(F.get(barred, F.col("template")), x["word"]))
    changed = F.exists("stops", lambda x: x["at"].between(F.col("start"), F.col("end") - 1) & x["word"].isin(CHANGES)
                       & ~F.exists("ats", lambda a: x["at"].between(a, a + gram - 1)))
    inserted = F.col("end") - F.col("start") - F.size(words_of("ats"))
    # a span inside a changed one of its template is a part of the same text, so it goes with it
    same = Window.partitionBy("key", "template")
    found = found.join(once.select("key", "stops"), "key").withColumn("changed", F.when(changed, F.struct("start", "end"))) \
        .withColumn("all_changed", F.collect_set("changed").over(same)).filter(~stopped)
    inside = F.exists("all_changed", lambda c: (c["start"] <= F.col("start")) & (c["end"] >= F.col("end")))
    return found.filter(~inside).select(
        "key", "template", "label", "start", "end", (F.size("covered") / (F.col("length") + inserted)).alias("score"))


def scan(docs: DataFrame, templates: list = TEMPLATES, phrases: list = PHRASES, gram: int = GRAM, slack: int = SLACK, cover: float = COVER,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    scanned = written(_hits(docs, templates, phrases, gram, id_col, text_col), "licenses")
    voted = spans(scanned, templates, gram, slack, cover).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    none = F.array().cast("array<string>")
    out = join_spread(scanned.drop("hits", "stops"), voted, "key")
    return out.select(
        F.col("i").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
