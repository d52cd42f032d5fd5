"""Licence scans by a positional index of rare words. DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import held

# Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of notices, and the phrases that one of each label must hold.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "released under the mit license",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
        "of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution neither the "
        "name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",),
    "cc0": (
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and "
        "related or neighboring rights to this work",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation either version 2 1 of the license or at "
        "your option any later version",
    ),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
        "general public license as published by the free software foundation either version 3 of the license or at "
        "your option any later version",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
        "not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject "
        "to the following restrictions",
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license to use reproduce display distribute execute and transmit "
        "the software and to prepare derivative works of the software",
        "distributed under the boost software license version 1 0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
    ),
}
MANDATORY = {
    "mit": (
        "mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to",
    ),
    "apache": ("apache license",),
    "gpl": ("general public license",),
    "bsd": ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"),
    "cc-by": ("creative commons attribution 4 0",),
    "cc-by-nc": ("cc by nc",),
    "cc-by-sa": ("creative commons attribution sharealike",),
    "cc0": ("cc0",),
    "lgpl": ("lesser general public license",),
    "agpl": ("affero general public license",),
    "mpl": ("mozilla public license",),
    "isc": ("with or without fee is hereby granted",),
    "zlib": ("without any express or implied warranty",),
    "boost": ("boost software license", "to any person or organization obtaining a copy of the software"),
    "unlicense": ("free and unencumbered software",),
}
SEEDS = 8  # rarest words of each template, of those a text holds, that are looked up
NEAR = 4  # words by which an aligned template may shift
AGREE = 0.6  # share of a template's seeds in the text that must agree on its place


# What stands between words once A-Z are lower-cased.
SPLITTER = r"[^0-9a-z\x80-\x{10FFFF}]++"
VOCABULARY = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
# A template in the index: its words, rarest first, and where each of them stands in it.
INDEX = "array<struct<label:string,phrases:array<string>,words:array<string>,places:array<array<int>>>>"


def spaced(text: Column) -> Column:
    """The words of a text, each between single blanks: runs of digits, letters and characters
    beyond ASCII, with A-Z lower-cased. A text without words is one blank."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # Of all other characters only these two have small forms with ASCII letters.
    odd = text.contains("K") | text.contains("İ")
    small = F.when(odd, F.translate(text, capitals, capitals.lower())).otherwise(F.lower(text))
    return F.regexp_replace(F.concat(F.lit(" "), small, F.lit(" ")), SPLITTER, " ")


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _holds(norm: Column, phrase: Column) -> Column:
    return F.contains(norm, F.concat(F.lit(" "), phrase, F.lit(" ")))


def rarities(worded: DataFrame) -> list[tuple[str, float]]:
    """(word, IDF) of the licence words over all rows with a column `norm` as spaced() gives,
    rarest first; ties by word. One aggregate over the table; the driver gets one number for
    each word of the templates."""
    listed = F.array(*(F.lit(w) for w in VOCABULARY), F.lit(""))  # each row ends in an empty word
    present = worded.select(F.explode(F.array_intersect(listed, F.split("norm", " "))).alias("word"))
    counts = {r["word"]: r["n"] for r in present.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in VOCABULARY}
    return sorted(idf.items(), key=lambda x: (-x[1], x[0]))


def index(ranked: list[str]) -> Column:
    """The postings of all templates as one constant: word, template and place."""
    rank = {w: k for k, w in enumerate(ranked)}
    entries = []
    for label, texts in TEMPLATES.items():
        for template in texts:
            postings: dict[str, list[int]] = {}
            for place, word in enumerate(template.split()):
                postings.setdefault(word, []).append(place)
            known = sorted(postings, key=rank.__getitem__)
            entries.append({
                "label": label, "phrases": MANDATORY[label], "words": known, "places": [postings[w] for w in known]})
    return F.from_json(F.lit(json.dumps(entries)), INDEX)


def scanned(docs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, by row.

    Base labels are those of the phrases in PHRASES, wherever their words stand
    consecutively. The method adds a label where the rarest words that the text shares with one
    of its templates stand as they do there and one of its mandatory phrases is there: the words
    are looked up in the index of template postings, each posting says where the template would
    begin, and the part of the seeds that agree on a place (within NEAR words) is the score; base
    labels score 1. Each template has seeds of its own, however common its words are: a text
    that holds all of a template scores 1. Null and empty texts have no words, no label and
    score 0. Repeated rows are judged alike, each by itself. Texts are read whole in their row,
    whatever their length. Other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worded = held(docs.select("doc_id", text.alias("text")), norm=spaced(F.col("text"))).drop("text")
    postings = index([w for w, _ in rarities(worded)])
    norm = F.col("norm")
    around = {f"around{k}": F.when(_holds(norm, F.lit(p)), F.split(norm, f" {p}(?= )", -1)) for k, p in enumerate(PHRASES)}
    # Only a template one of whose mandatory phrases is there can give a label.
    wanted = F.filter(postings, lambda t: F.exists(t["phrases"], lambda p: _holds(norm, p)))
    texts = held(worded, n_words=(_blanks(norm) - 1).cast("long"), wanted=wanted, **around)
    texts = held(texts, words=F.when(F.size("wanted") > 0, F.filter(F.split(norm, " "), lambda w: w != ""))).drop("norm")
    texts = held(texts, found=_agreed(F.col("wanted"), F.col("words"), seeds)).drop("wanted", "words")
    # Pieces of a text around a phrase: blanks count the words before and after it.
    first, last, labels, places = [], [], [], F.lit(0)
    for k, (phrase, label) in enumerate(PHRASES.items()):
        pieces = F.col(f"around{k}")
        first.append(_blanks(F.get(pieces, F.lit(0))))
        last.append(F.col("n_words") + 1 - _blanks(F.element_at(pieces, -1)) - len(phrase.split()))
        labels.append(F.when(pieces.isNotNull(), F.lit(label)))
        places = places + F.coalesce(F.size(pieces) - 1, F.lit(0))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    texts = held(
        texts, base=base, n_base=places.cast("long"),
        first_word=F.least(*first).cast("long"), last_word=F.greatest(*last).cast("long"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda x: x["label"]))))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return texts.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def _agreed(wanted: Column, at: Column, seeds: int) -> Column:
    """(label, score) of the templates whose seeds agree on a place: see scanned(). Each step
    is an array of its own, so that nothing is worked out once for every word."""
    looked_up = F.transform(wanted, lambda t: F.struct(
        t["label"].alias("label"), t["words"].alias("known"), t["places"].alias("places"),
        F.slice(F.array_intersect(t["words"], at), 1, seeds).alias("chosen")))
    standing = F.transform(looked_up, lambda t: F.struct(
        t["label"].alias("label"), F.size(t["chosen"]).alias("size"),
        F.transform(t["chosen"], lambda w: F.get(t["places"], F.array_position(t["known"], w).cast("int") - 1)).alias("places"),
        F.filter(
            F.transform(at, lambda w, i: F.struct(F.array_position(t["chosen"], w).cast("int").alias("seed"), i.alias("place"))),
            lambda x: x["seed"] > 0).alias("seen")))
    # The beginnings that each standing word votes for, in order: those of a stretch of NEAR
    # words are neighbours.
    voted = F.transform(standing, lambda t: F.struct(
        t["label"].alias("label"), t["size"].alias("size"),
        F.array_sort(F.flatten(F.transform(t["seen"], lambda x: F.transform(
            F.get(t["places"], x["seed"] - 1),
            lambda p: F.struct((x["place"] - p).alias("begin"), x["seed"].alias("seed")))))).alias("votes")))
    none = F.array().cast("array<struct<begin:int,seed:int>>")
    scored = F.transform(voted, lambda t: F.struct(
        t["label"].alias("label"),
        F.when(t["size"] > 0, F.aggregate(
            t["votes"], F.struct(none.alias("near"), F.lit(0).alias("most")), _step, lambda s: s["most"]) / t["size"],
        ).otherwise(F.lit(0.0)).alias("score")))
    return F.when(F.size(wanted) > 0, F.filter(scored, lambda t: t["score"] >= AGREE)).otherwise(
        F.array().cast("array<struct<label:string,score:double>>"))


def _step(at: Column, vote: Column) -> Column:
    near = F.concat(F.filter(at["near"], lambda x: x["begin"] >= vote["begin"] - NEAR), F.array(vote))
    different = F.size(F.array_distinct(F.transform(near, lambda x: x["seed"])))
    return F.struct(near.alias("near"), F.greatest(at["most"], different).alias("most"))
