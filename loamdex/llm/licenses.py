"""License scans as an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or a run of SPAN times as many consecutive words as the
template has, wherever lines break; a template is a short license notice. Both are sets of
words, and a block meets a template if it holds at least THRESHOLD of the template's words.
Templates that differ in a word or two would meet together, so a block must also hold what
tells a template from such siblings, and not be one of a sibling that says more (Template).

A document with such a block holds as many of the template's words itself, so candidates come
from an exact join of whole documents. Words are ordered by the documents they are in, rarest
first, so a template's prefix (as many words as may be missing, and one more) must meet the
document: the join runs on prefix words, and length and position filters drop most of what is
left. The blocks of a candidate are then tested one by one.

Texts are cut into words once. Only words of some template take part in the join, so documents
are cut down to these, and texts go on only where some template's words are all but there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.textops import NOT_WORD, ascii_lower, checkpointed, let, whole, words

#: Phrases of consecutive words and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as they stand above or below public texts, by label.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "copyright-notice": ["copyright c all rights reserved"],
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
THRESHOLD = 0.9
#: Words of a block that spans lines, to each word of the template.
SPAN = 1.5


@dataclass(frozen=True)
class Template:
    """Another label's template that would meet this one is a sibling. needed: words that some sibling lacks. others: what siblings that hold all of this one's words have besides."""

    label: str
    words: tuple[str, ...]
    need: int
    span: int
    needed: tuple[str, ...] = ()
    others: tuple[tuple[str, ...], ...] = ()

    @property
    def watched(self) -> list[str]:
        return sorted({*self.words, *(w for o in self.others for w in o)})


def compiled(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    plain = []
    for label, texts in templates.items():
        for t in texts:
            own = tuple(sorted(set(t.split())))
            plain.append(Template(label, own, max(1, math.ceil(threshold * len(own) - 1e-9)), math.ceil(SPAN * len(t.split()))))
    out = []
    for t in plain:
        siblings = [set(s.words) for s in plain if s.label != t.label and len({*s.words} & {*t.words}) >= t.need]
        needed = sorted({w for s in siblings for w in {*t.words} - s})
        others = sorted(tuple(sorted(s - {*t.words})) for s in siblings if s > {*t.words})
        out.append(replace(t, needed=tuple(needed), others=tuple(others)))
    return out


def _array(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _held(block: Column) -> Column:
    """Template words in a block, 0 if it isn't the template's."""
    told = (F.size(F.array_except("_needed", block)) == 0) & ~F.exists("_others", lambda o: F.size(F.array_except(o, block)) == 0)
    return F.when(told, F.size(F.array_intersect("_template", block))).otherwise(0)


def most_in_lines(text: str) -> Column:
    """The most template words that one line of the template's holds."""
    return F.array_max(F.transform(F.split(text, "\n"), lambda line: _held(words(line))))


def most_in_windows(text: str) -> Column:
    """The most template words that a run of _span consecutive words of the template's holds, wherever lines break. Only runs that begin with a template word need a look."""
    every = F.transform(words(F.col(text)), lambda w, i: F.struct(i.alias("i"), w.alias("w")))

    def best(own: Column) -> Column:
        run = lambda x, k: F.filter(F.slice(own, k + 1, F.col("_span")), lambda y: y["i"] < x["i"] + F.col("_span"))["w"]
        return F.array_max(F.transform(own, lambda x, k: F.when(F.array_contains("_template", x["w"]), let(run(x, k), _held)).otherwise(0)))

    return let(F.filter(every, lambda x: F.array_contains("_watched", x["w"])), best)


def read(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """doc_id, _row, n_words, the places of phrases, _t (distinct template words), and _text (lower-cased) where some template may be met."""
    vocabulary = _array(sorted({w for t in templates for w in t.words}))
    lowered = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), ascii_lower(whole()).alias("_text"))
    phrase = "|".join(NOT_WORD.join(p.split()) for p in PHRASES)
    rows = lowered.withColumn("_w", words(F.col("_text"))).withColumn("_t", F.array_intersect(vocabulary, "_w")).withColumn("_maybe", F.col("_text").rlike(phrase))

    def places(p: str) -> Column:
        first, *more = p.split()

        def hit(x: Column, i: Column) -> Column:
            same = x == first
            for k, w in enumerate(more, 1):
                same = same & F.get(F.col("_w"), i + k).eqNullSafe(F.lit(w))
            return F.when(same, i)

        found = F.filter(F.transform(F.col("_w"), hit), lambda i: i.isNotNull())
        return F.when(F.col("_maybe"), found).otherwise(F.array().cast("array<int>"))

    met = reduce(or_, [F.size(F.array_intersect(_array(t.words), "_t")) >= t.need for t in templates], F.lit(False))
    return rows.select("doc_id", "_row", F.size("_w").cast("long").alias("n_words"), *[places(p).alias(f"_p{k}") for k, p in enumerate(PHRASES)], "_t", F.when(met, F.col("_text")).alias("_text"))


def template_matches(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """All (document, template) pairs of which a block meets the template: _row, _label, _containment (of the best block). rows: read(), stored."""
    vocabulary = sorted({w for t in templates for w in t.words})
    # as many rows as the templates have words
    seen = rows.select(F.explode("_t").alias("_w")).groupBy("_w").count().collect()
    frequency = dict.fromkeys(vocabulary, 0) | {r["_w"]: r["count"] for r in seen}
    order = sorted(vocabulary, key=lambda w: (frequency[w], w))
    place = {w: i for i, w in enumerate(order)}

    prefixes = []
    for t in templates:
        own = sorted(t.words, key=place.get)
        prefix = own[: len(own) - t.need + 1]
        prefixes += [(w, t.label, own, prefix, len(own), t.span, t.need, [*t.needed], [[*o] for o in t.others], t.watched, i) for i, w in enumerate(prefix)]
    schema = "_w string, _label string, _template array<string>, _prefix array<string>, _size int, _span int, _need int, _needed array<string>, _others array<array<string>>, _watched array<string>, _i int"
    known = rows.sparkSession.createDataFrame(prefixes, schema)
    # an intersection keeps the order of its first argument
    ordered = rows.filter("_text is not null").select("_row", "_text", F.array_intersect(_array(order), "_t").alias("_t"))
    met = ordered.select("_row", "_text", "_t", F.posexplode("_t").alias("_j", "_w")).join(F.broadcast(known), "_w")
    met = met.filter(F.size("_t") >= F.col("_need"))
    rest = F.least(F.col("_size") - F.col("_i"), F.size("_t") - F.col("_j"))
    met = met.filter(F.least("_i", "_j") + rest >= F.col("_need"))
    # a pair comes once for each prefix word that it shares: the first stands for it
    met = met.filter((F.get(F.array_intersect("_prefix", "_t"), F.lit(0)) == F.col("_w")) & (F.size(F.array_intersect("_template", "_t")) >= F.col("_need")))
    common = F.greatest(most_in_lines("_text"), most_in_windows("_text"))
    # an array of one or none, so that the blocks are looked through once
    best = F.filter(F.array(common), lambda c: c >= F.col("_need"))
    return met.select("_row", "_label", "_size", F.explode(best).alias("_common")).select("_row", "_label", (F.col("_common") / F.col("_size")).alias("_containment"))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best containment of a met template, 1 if a phrase occurs, else 0. A null or
    empty text has no words, no labels and score 0; first_word and last_word are null without
    phrases; repeated rows get equal results; an empty table gives no rows.
    """
    known = compiled(templates, threshold)
    rows = checkpointed(read(docs, known))
    every = F.concat(*[f"_p{k}" for k in range(len(PHRASES))])
    base = rows.select(
        "doc_id", "_row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])).alias("_base"))
    per = template_matches(rows, known).groupBy("_row").agg(F.collect_set("_label").alias("_more"), F.max("_containment").alias("_best"))
    out = base.join(per, "_row", "left")
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("_base").alias("base_labels"),
        joined(F.concat("_base", F.coalesce("_more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
