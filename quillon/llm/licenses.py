"""License scanning with a positional rare-token index, in DataFrame functions only.

Templates are the notices and bodies of licences, cut where files differ.  Their
rare words (those of few templates) make an inverted index with positions.  A file
looks up, for each template of which it has enough rare words, those of the highest
IDF (over all files) that it shares with the template, so notices of one file take
no words from each other.  Every occurrence votes, through the postings, for the
place at which the template would begin in the file; where enough of the words
agree on one place, the mandatory key phrases are verified at their places.  Phrases
of the base list are found wherever their words stand consecutively.

Null or empty text: no words, no labels, score 0.  Repeated files: each is
scanned by itself (a row key is made first, so equal ids are told apart).  Ties in
IDF: by word.  Very long files: one row's words are an array.  No files: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint

# Phrases and labels of the base scan.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Label, mandatory key phrases, words of the licence text.
TEMPLATES = [
    ("mit", ["mit license"], "released under the mit license"),
    ("mit", ["permission is hereby granted free of charge"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", ["merge publish distribute sublicense"], "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2.0", ["apache license version 2 0"], "licensed under the apache license version 2 0"),
    ("apache-2.0", ["apache license version 2 0", "except in compliance with the license"], "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", ["governing permissions and limitations under the license"], "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", ["as defined by sections 1 through 9 of this document"], "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("gpl", ["gnu general public license"], "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", ["see the gnu general public license for more details"], "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-2.0", ["gnu general public license", "either version 2 of the license"], "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", ["gnu general public license", "either version 3 of the license"], "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0", ["gnu general public license version 3"], "this work is licensed under the gnu general public license version 3"),
    ("lgpl", ["gnu lesser general public license"], "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", ["gnu affero general public license"], "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", ["redistribution and use in source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", ["redistributions of source code must retain"], "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", ["redistributions in binary form must reproduce"], "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", ["endorse or promote products derived from this software"], "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2.0", ["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", ["permission to use copy modify"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", ["held liable for any damages arising from the use of this software"], "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", ["alter it and redistribute it freely"], "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1.0", ["accompanying documentation covered by this license"], "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("epl", ["eclipse public license"], "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("wtfpl", ["changing it is allowed as long as the name is changed"], "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc-by-nc-4.0", ["cc by nc 4 0"], "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", ["cc by sa 4 0"], "licensed under cc by sa 4 0"),
    ("cc-by-4.0", ["cc by 4 0"], "licensed under cc by 4 0"),
    ("cc0", ["cc0 1 0 universal"], "released under cc0 1 0 universal"),
    ("unlicense", ["released into the public domain"], "this is free and unencumbered software released into the public domain"),
    ("unlicense", ["commercial or non commercial and by any means"], "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
# Words of more templates than this are not rare enough for the index.
MOST_TEMPLATES = 6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def index(templates=None, most: int = MOST_TEMPLATES) -> list[tuple[str, int, int]]:
    """Postings (word, template, position) of the rare words."""
    seqs = [t[2].split() for t in templates or TEMPLATES]
    df = Counter(w for s in seqs for w in set(s))
    return [(w, k, i) for k, s in enumerate(seqs) for i, w in enumerate(s) if df[w] <= most]


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS), "")


def places(words: Column, phrase: str) -> Column:
    """Start positions of the phrase; its last word is looked for first, and only in texts that have it."""
    parts = phrase.split()
    k = len(parts) - 1
    at = F.filter(F.transform(words, lambda w, i: F.when(w == parts[-1], i - k)), lambda i: i >= 0)
    for j, p in enumerate(parts[:-1]):
        at = F.filter(at, _word_at(words, j, p))
    return F.when(F.array_contains(words, parts[-1]), at).otherwise(F.array().cast("array<int>"))


def _word_at(words: Column, j: int, word: str):
    return lambda i: F.get(words, i + j) == word


def key_places(template: int) -> list[tuple[int, list[str]]]:
    """(position in the template, words) of its key phrases."""
    _, keys, notice = TEMPLATES[template]
    out = []
    for key in keys:
        m = re.search(rf"(^|\s){re.escape(key)}(\s|$)", notice)
        out.append((len(notice[: m.start()].split()), key.split()))
    return out


def scan(docs: DataFrame, rarest: int = 8, agree: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    rarest: so many of a file's words, those of the highest IDF, are looked up for each template.
    agree: share of those (of all rare words, if a template has fewer) which must agree on a place.
    score: the largest such share, 1 at a base phrase, 0 without labels.
    """
    spark = docs.sparkSession
    postings = index()
    rare = sorted({w for w, _, _ in postings})
    of_template = [sorted({w for w, k, _ in postings if k == t}) for t in range(len(TEMPLATES))]
    looked = [min(len(words), rarest) for words in of_template]
    stored = sorted({*rare, *(w for k in range(len(TEMPLATES)) for _, words in key_places(k) for w in words)})
    words = lambda ws: F.array(*map(F.lit, ws))
    base = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    base = base.select("doc_id", "words", F.array_intersect("words", words(rare)).alias("present"))
    # templates of which the file has enough rare words for the agreement asked for
    enough = [F.when(F.size(F.array_intersect("present", words(ws))) >= math.ceil(agree * n - 1e-9), F.lit(k)) for k, (ws, n) in enumerate(zip(of_template, looked, strict=True))]
    some = F.size("present") >= min(math.ceil(agree * n - 1e-9) for n in looked)
    base = base.withColumn("open", F.when(some, F.filter(F.array(*enough), lambda k: k.isNotNull())))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(stored), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    found = [(places(F.col("words"), p), label) for p, label in PHRASES]
    # words are gone from here on: the rest of the scan works on few rows
    table = checkpoint(
        base.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
            F.array(*[f for f, _ in found]).alias("found"), "present", "open", F.when(F.size("open") > 0, hits).alias("hits"),
        )
    )
    df = table.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("df"))  # as many rows as the index has words
    post = F.broadcast(spark.createDataFrame(postings, "word string, template int, position int"))
    known = F.broadcast(spark.createDataFrame([(w, k) for k, ws in enumerate(of_template) for w in ws], "word string, template int"))
    keys = F.broadcast(spark.createDataFrame([(k, looked[k], t[0], key_places(k)) for k, t in enumerate(TEMPLATES)], "template int, looked int, label string, keys array<struct<position: int, words: array<string>>>"))
    few = table.filter(F.size("open") > 0)
    asked = few.select("row", F.explode("open").alias("template"), "present").select("row", "template", F.explode("present").alias("word")).join(known, ["word", "template"]).join(F.broadcast(df), "word")
    asked = asked.withColumn("rank", F.row_number().over(W.partitionBy("row", "template").orderBy("df", "word"))).filter(F.col("rank") <= rarest).select("row", "template", "word")
    hit = few.select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.word")
    votes = hit.join(asked, ["row", "word"]).join(post, ["word", "template"]).groupBy("row", "template", (F.col("at") - F.col("position")).alias("begin")).agg(F.count_distinct("word").alias("votes"))
    agreed = votes.join(keys, "template").withColumn("share", F.col("votes") / F.col("looked")).filter(F.col("share") >= agree - 1e-9)
    # only where enough words agree are the key phrases looked at
    stands = lambda k: F.transform(F.filter("hits", lambda h: (h["at"] >= F.col("begin") + k["position"]) & (h["at"] < F.col("begin") + k["position"] + F.size(k["words"]))), lambda h: h["word"]) == k["words"]
    matched = agreed.join(few.select("row", "hits"), "row").filter(F.forall("keys", stands)).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    out = table.drop("hits", "open", "present").join(matched, "row", "left")
    flat = F.flatten("found")
    base_labels = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda x, i: F.when(F.size(x) > 0, F.element_at(F.array(*[F.lit(label) for _, label in found]), i + 1))), lambda x: x.isNotNull())))
    return out.select(
        "doc_id", "n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(flat) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
