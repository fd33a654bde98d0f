"""License scan by diagonal voting, with DataFrame functions only.

Words are runs of letters and digits with A-Z lower-cased.  Every rolling gram
of every text, of two words and of five, is hashed and joined with the gram
positions of the license templates: notices of a line or two by two words, whole
license texts by five, so that common pairs of words do not vote for these.  A hit votes for the diagonal "text place minus
template place", which is where the template would start.  Votes are counted
per text, template and diagonal; diagonals of one template that lie within
``SLACK`` of each other are one find (words were left out or put in); a find
with enough of the template's grams becomes a span, and each span is verified
on the words themselves.

Exact phrases are templates too, without slack: a diagonal counts if it holds
all their grams.  The texts here are short licenses; longer ones are given by
the caller (``wording``, with the names of holders and years left out).

The templates are a fixed, small table, so their side of the join is
broadcast.  The spans go back to the texts by a broadcast only while they are
at most ``BROADCAST_SPANS`` rows of a fixed width; beyond that by a shuffle.

Defined results: null, empty and word-less texts have no words, no labels and
score 0; the whole text is scanned; a text of one word has no gram; repeated
rows are scanned each; an empty table gives an empty table; extra columns pass
through, and one called like an output column is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fixed, numbered, renamed, row_key

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GRAM = 2
#: Templates of at least so many words vote by longer grams.
LONG_GRAM = 5
LONG_WORDS = 60
SLACK = 3
LEAST_SHARE = 0.8
BROADCAST_SPANS = 100_000

#: Exact phrases and their labels (fixed values).
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Wording of public licenses and of the usual notices, and their labels
#: (fixed values).
TEMPLATES = {
    "licensed under cc by": "cc",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution": "cc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "bsd 3 clause license": "bsd",
    "bsd 2 clause license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except "
    "in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted": "isc",
}

_NO_WARRANTY = (
    "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list "
    "of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution {clause}this software is provided by the copyright holders and contributors as is and any express "
    "or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
    "of substitute goods or services loss of use data or profits or business interruption however caused and on any "
    "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage")

#: Whole texts of the short public licenses, and their labels (fixed values).
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the software the "
    "software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
    "authors or copyright holders be liable for any claim damages or other liability whether in an action of "
    "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
    "in the software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met 1 " + _NO_WARRANTY.format(clause=""): "bsd-2-clause-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met 1 " + _NO_WARRANTY.format(
        clause="3 neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission "): "bsd-3-clause-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies the software "
    "is provided as is and the author disclaims all warranties with regard to this software including all implied "
    "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
    "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
    "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this software": "isc-text",
    "this software is provided as is without any express or implied warranty in no event will the authors be held "
    "liable for any damages arising from the use of this software permission is granted to anyone to use this "
    "software for any purpose including commercial applications and to alter it and redistribute it freely subject "
    "to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that "
    "you wrote the original software if you use this software in a product an acknowledgment in the product "
    "documentation would be appreciated but is not required 2 altered source versions must be plainly marked as "
    "such and must not be misrepresented as being the original software 3 this notice may not be removed or altered "
    "from any source distribution": "zlib-text",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
    "use compile sell or distribute this software either in source code form or as a compiled binary for any "
    "purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the "
    "author or authors of this software dedicate any and all copyright interest in the software to the public "
    "domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law": "unlicense-text",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http "
    "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
    "distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
    "either express or implied see the license for the specific language governing permissions and limitations "
    "under the license": "apache-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your option "
    "any later version this program is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
    "public license for more details you should have received a copy of the gnu general public license along with "
    "this program": "gpl-header",
}


class Template(NamedTuple):
    number: int
    label: str
    words: list[str]
    exact: bool

    @property
    def gram(self) -> int:
        return LONG_GRAM if len(self.words) >= LONG_WORDS and not self.exact else GRAM

    @property
    def grams(self) -> list[str]:
        return [" ".join(self.words[i:i + self.gram]) for i in range(len(self.words) - self.gram + 1)]


def templates(phrases: dict[str, str] = PHRASES, wording: dict[str, str] = TEMPLATES | TEXTS) -> list[Template]:
    rows = [(t, label, True) for t, label in phrases.items()]
    rows += [(t, label, False) for t, label in wording.items()]
    return [Template(k, label, text.split(), exact) for k, (text, label, exact) in enumerate(rows)]


def words_of(text: Column) -> Column:
    # Of the non-ASCII characters only the Kelvin sign lower-cases to an ASCII
    # letter, and it would be a word character either way.
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _hash(words: str, gram: int, at: str) -> str:
    return "xxhash64(" + ", ".join(f"get({words}, {at} + {k})" for k in range(gram)) + ")"


def _facts(items: list[Template]) -> Column:
    """The template table as one constant: per number its length, grams, ..."""
    return F.array(*[F.struct(
        F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact"), F.lit(t.gram).alias("gram"),
        F.split(F.lit("|".join(t.grams)), "[|]").alias("grams")) for t in items])


def votes(docs: DataFrame, items: list[Template], id_col: str, text_col: str) -> DataFrame:
    """Per text, template and diagonal: the template places that voted."""
    rows = docs.select(*row_key(id_col, text_col), words_of(F.col(text_col)).alias("words"))
    table = docs.sparkSession.createDataFrame(
        [(t.number, t.gram, k, t.words[k:k + t.gram]) for t in items for k in range(len(t.grams))],
        "template int, gram int, at int, words array<string>")
    pair, long = (F.expr(_hash("words", gram, "0")) for gram in (GRAM, LONG_GRAM))
    table = table.select("gram", F.when(F.col("gram") == GRAM, pair).otherwise(long).alias("h"), "template", "at",
                         pair.alias("pair"))
    # The first two words of the templates' grams: a fixed, small set.  Only
    # places with one of them are hashed by longer grams and sent to the join.
    first = ", ".join(f"{r['pair']}L" for r in table.select("pair").distinct().orderBy("pair").collect()) or "NULL"
    rows = rows.withColumn("pairs", F.expr(
        f"transform(slice(words, 1, greatest(size(words) - {GRAM - 1}, 0)), (w, i) -> {_hash('words', GRAM, 'i')})"))
    rows = rows.withColumn("starts", F.expr(
        f"filter(transform(pairs, (h, i) -> if(h in ({first}), i, null)), i -> i is not null)"))
    places = rows.select("_id", "_th", F.inline(F.expr(
        f"concat(transform(starts, i -> struct(i as place, {GRAM} as gram, get(pairs, i) as h)), "
        f"transform(filter(starts, i -> i + {LONG_GRAM} <= size(words)), "
        f"i -> struct(i as place, {LONG_GRAM} as gram, {_hash('words', LONG_GRAM, 'i')} as h)))")))
    hits = places.join(F.broadcast(table.drop("pair")), ["gram", "h"])  # some 1,500 fixed rows
    # Repeated rows vote twice for the same places, hence sets.
    return hits.groupBy("_id", "_th", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("at"))


def spans(found: DataFrame, items: list[Template]) -> DataFrame:
    """Candidate spans: ``_id``, ``_th``, ``template``, ``first`` (start of the
    template), ``stop`` (after its last word)."""
    fact = F.element_at(_facts(items), F.col("template") + 1)
    order = Window.partitionBy("_id", "_th", "template").orderBy("diagonal")
    slack = F.when(fact["exact"], F.lit(0)).otherwise(F.lit(SLACK))
    # A diagonal with too few votes of its own still joins its neighbours.
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    merged = (found.withColumn("fresh", fresh.cast("int"))
              .withColumn("find", F.sum("fresh").over(order))
              .groupBy("_id", "_th", "template", "find").agg(
                  F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"),
                  F.min(F.col("diagonal") + F.array_min("at")).alias("low"),
                  F.max(F.col("diagonal") + F.array_max("at")).alias("high"),
                  F.min("diagonal").alias("first")))
    share = F.when(fact["exact"], F.lit(1.0)).otherwise(F.lit(LEAST_SHARE))
    return merged.where(F.col("n") >= share * F.size(fact["grams"])).select(
        "_id", "_th", "template",
        F.when(fact["exact"], F.col("first")).otherwise(F.col("low")).alias("first"),
        (F.col("high") + fact["gram"]).alias("stop"))


def verified(docs: DataFrame, found: DataFrame, items: list[Template], id_col: str,
             text_col: str) -> DataFrame:
    """The spans with ``share``, the part of the template's grams that the
    words of the span hold, where it reaches the least share."""
    found = fixed(found)
    few = found.limit(BROADCAST_SPANS + 1).count() <= BROADCAST_SPANS
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(found) if few else found, ["_id", "_th"])
    fact = F.element_at(_facts(items), F.col("template") + 1)
    joined = joined.withColumn("words", words_of(F.col("text"))).withColumn(
        "words", F.expr("slice(words, first + 1, stop - first)")).drop("text")
    joined = joined.withColumn("gram", fact["gram"])
    grams = F.expr("transform(slice(words, 1, size(words) - gram + 1), "
                   "(w, i) -> concat_ws(' ', slice(words, i + 1, gram)))")
    shared = F.size(F.array_intersect(fact["grams"], grams)) / F.size(F.array_distinct(fact["grams"]))
    least = F.when(fact["exact"], F.lit(1.0)).otherwise(F.lit(LEAST_SHARE))
    return joined.select("_id", "_th", "template", "first", "stop", fact["label"].alias("label"),
                         fact["exact"].alias("exact"), shared.alias("share")).where(
        F.col("share") >= least).distinct()


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] = PHRASES, wording: dict[str, str] = TEMPLATES | TEXTS) -> DataFrame:
    """The verified spans of all texts: ``_id``, ``_th`` (``row_key``),
    ``template``, ``label``, ``exact``, ``first``, ``stop``, ``share``."""
    items = templates(phrases, wording)
    return verified(docs, spans(votes(docs, items, id_col, text_col), items), items, id_col, text_col)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: dict[str, str] = PHRASES, wording: dict[str, str] = TEMPLATES | TEXTS) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``n_base`` (places of the
    exact phrases), ``first_word``, ``last_word`` (their smallest and largest
    start), ``base_labels``, ``labels`` and ``score``."""
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    columns = [c for c in docs.columns if c != text_col and (c == id_col or c not in made)]
    docs, new = numbered(docs)
    id_col, text_col = new(id_col), new(text_col)
    found = find_licenses(docs, id_col, text_col, phrases, wording)
    exact = F.col("exact")
    per_text = found.groupBy("_id", "_th").agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("first"))).cast("long").alias("last_word"),
        F.collect_set(F.when(exact, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("share").alias("score"))
    joined_labels = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    key = row_key(id_col, text_col)
    counted = docs.withColumns({
        "_id": key[0], "_th": key[1], "n_words": F.size(words_of(F.col(text_col))).cast("long")})
    done = counted.drop(text_col).join(per_text, ["_id", "_th"], "left").withColumns({
        "n_base": F.coalesce("n_base", F.lit(0)).cast("long"),
        "base_labels": joined_labels("base_labels"),
        "labels": joined_labels("labels"),
        "score": F.coalesce("score", F.lit(0.0)).cast("double"),
    })
    return done.select(*renamed(done, columns, new), *(c for c in made if c not in columns))
