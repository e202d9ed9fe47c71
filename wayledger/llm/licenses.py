"""Licence scans by a positional index of rare words.

Each template is a passage of a licence. Of its words the rarest ones, by the number of documents that
hold them, are filed with their places. A file's words that stand in the index are looked up; each
occurrence says where a template would begin, and where enough of a template's filed places agree, the
passage is there if its mandatory phrases stand at their places. All of it is one expression over a
row: no row is moved, and the corpus gives one count per word of the templates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import materialise

#: What ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` matches once A-Z are lower-cased, said by what it holds: Java takes a third of the time.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Filed words of a template, and the share of its filed places that must agree.
FILED, AGREEING = 8, 0.6
#: Score of a file that has base places only.
BASE_SCORE = 0.5


@dataclass(frozen=True)
class Template:
    """A label, the words of a passage, and the phrases of it without which it is not that licence."""

    label: str
    text: str
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """(place, words) of each mandatory phrase: its first occurrence in the text."""
        found = []
        for phrase in self.mandatory:
            p = phrase.split()
            places = [k for k in range(len(self.words)) if self.words[k:k + len(p)] == p]
            if not places:
                raise ValueError(f"{phrase!r} is not part of the template of {self.label}")
            found.append((places[0], p))
        return found


#: Phrases that are licences by themselves, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words of public licence notices.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
             "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
             "distribute sublicense and or sell copies of the software",
             ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mit", "released under the mit license", ("under the mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
             "you may obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation either version 2 of the license or at your option any later version",
             ("gnu general public license as published by", "either version 2 of the license")),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation either version 3 of the license or at your option any later version",
             ("gnu general public license as published by", "either version 3 of the license")),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
             ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
             ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
             "conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission",
             ("endorse or promote products derived from this software",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
             "that the above copyright notice and this permission notice appear in all copies",
             ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
             "distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution 4 0 international",)),
)


def lowered(word: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(word, UPPER, LOWER)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for phrase, _ in base for w in phrase.split()})


def listed(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, **keep: Column) -> DataFrame:
    """(keep, n_words, present, words) for every row of (text), written once: the licence words that a text holds, and
    all its words, lower-cased, if it holds every word of a base phrase or of all mandatory phrases of a template.

    Texts are cut into words once. Only different words are lower-cased where nothing else is asked of a text.
    """
    raw = F.coalesce(F.regexp_extract_all(F.col("__text"), F.lit(WORD), 0), F.array().cast("array<string>"))
    slim = once(docs.select(F.struct(*[c.alias(k) for k, c in keep.items()]).alias("keep"), F.col("text").cast("string").alias("__text")), __raw=raw)
    different = F.transform(F.array_distinct("__raw"), lowered)
    slim = once(slim.select("keep", "__raw"), present=F.array_intersect(different, _strings(vocabulary(templates, base))))
    wanted = {tuple(sorted(set(phrase.split()))) for phrase, _ in base} | {tuple(sorted({w for p in t.mandatory for w in p.split()})) for t in templates}
    asked = F.exists(F.array(*[_strings(list(w)) for w in sorted(wanted)]), lambda need: F.forall(need, lambda w: F.array_contains("present", w)))
    return materialise(slim.select("keep", F.size("__raw").cast("long").alias("n_words"), "present",
                                   F.when(asked, F.transform("__raw", lowered)).alias("words")))


def document_counts(rows: DataFrame, words: list[str]) -> dict[str, int]:
    """Number of rows of :func:`listed` that hold each of ``words``; one number per word reaches the driver."""
    held = rows.select(F.explode("present").alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in held}
    return {w: counts.get(w, 0) for w in words}


def index(counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, filed: int = FILED) -> list[tuple[Template, list[tuple[str, int]]]]:
    """(word, place) of each template's rarest words; of equally rare ones the first in the alphabet."""
    rows = []
    for t in templates:
        rare = set(sorted(set(t.words), key=lambda w: (counts.get(w, 0), w))[:filed])
        rows.append((t, [(w, k) for k, w in enumerate(t.words) if w in rare]))
    return rows


def needed(places: int, share: float = AGREEING) -> int:
    """Filed places that must agree: the share, rounded up."""
    return max(1, -int(-places * round(share * 100) // 100))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _index_column(filed: list[tuple[Template, list[tuple[str, int]]]]) -> Column:
    """The index as one constant. ``musts`` are a template's filed words that its mandatory phrases hold."""
    rows = []
    for t, places in filed:
        rare = sorted({w for w, _ in places})
        musts = [w for w in rare if any(w in p for _, p in t.phrases)]
        rows.append(F.struct(
            F.lit(t.label).alias("label"), _strings(t.words).alias("words"), _strings(rare).alias("rare"), _strings(musts).alias("musts"),
            F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("place")) for w, k in places]).alias("postings"),
            F.lit(needed(len(places))).alias("needed"),
            F.array(*[F.struct(F.lit(k).alias("place"), _strings(p).alias("words")) for k, p in t.phrases]).alias("phrases")))
    return F.array(*rows)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda's variable is, an expression would be at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(words: Column, phrase: list[str]) -> Column:
    """Places of a phrase whose words stand one behind the other."""
    fits = lambda w, i: F.when(
        (w == phrase[-1]) & (i >= len(phrase) - 1) & F.reduce(
            F.array(*[F.coalesce(F.get(words, i - k) == phrase[-1 - k], F.lit(False)) for k in range(1, len(phrase))]), F.lit(True), lambda a, b: a & b),
        i - (len(phrase) - 1))
    return F.array_compact(F.transform(words, fits))


def _matches(words: Column, found: Column, templates: Column) -> Column:
    """array<struct<label, share>>: each passage of ``templates`` that stands in ``words``, with the best share of
    its words at their places. ``found`` has the different filed words of the file."""
    n = F.size(words)

    def share(t: Column, begin: Column) -> Column:
        fits = F.transform(t["words"], lambda w, i: F.when(begin + i >= 0, F.get(words, begin + i)) == w)
        return F.size(F.filter(fits, lambda x: x)) / F.size(t["words"])

    def stands(t: Column, begin: Column) -> Column:
        return F.forall(t["phrases"], lambda p: (begin + p["place"] >= 0) & (begin + p["place"] < n) & (
            F.slice(words, F.greatest(begin + p["place"] + 1, F.lit(1)), F.size(p["words"])) == p["words"]))

    def best(t: Column, begins: Column) -> Column:
        # Each filed place gives a beginning once, so equal ones in a row are places that agree.
        agreed = F.array_distinct(F.array_compact(F.transform(begins, lambda b, i: F.when(F.get(begins, i + t["needed"] - 1) == b, b))))
        shares = F.transform(F.filter(agreed, lambda b: stands(t, b)), lambda b: share(t, b))
        return F.struct(t["label"].alias("label"), F.array_max(shares).alias("share"))

    def looked_up(t: Column, seen: Column) -> Column:
        begins = F.flatten(F.transform(t["postings"], lambda p: F.transform(
            F.filter(seen, lambda s: s["word"] == p["word"]), lambda s: s["at"] - p["place"])))
        return _let(F.sort_array(begins), lambda b: best(t, b))

    def whole(asked: Column) -> Column:
        rare = F.array_distinct(F.flatten(asked["rare"]))
        seen = _let(rare, lambda r: F.array_compact(F.transform(
            words, lambda w, i: F.when(F.array_contains(r, w), F.struct(w.alias("word"), i.alias("at"))))))
        return _let(seen, lambda s: F.filter(F.transform(asked, lambda t: looked_up(t, s)), lambda m: m["share"].isNotNull()))

    # What a passage cannot do without: the filed words of its phrases, and as many filed places as must agree.
    asked = F.filter(templates, lambda t: F.forall(t["musts"], lambda w: F.array_contains(found, w)) & (
        F.size(F.filter(t["postings"], lambda p: F.array_contains(found, p["word"]))) >= t["needed"]))
    return _let(asked, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.array().cast("array<struct<label:string,share:double>>")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, **keep: Column) -> DataFrame:
    """The ``keep`` columns and n_words, n_base, first_word, last_word, base_labels, labels and score for every row of (text).

    ``n_base`` counts all places of the base phrases, which may overlap; ``first_word`` and ``last_word`` are
    their least and largest beginning, null if there is none. ``labels`` are the base labels and those of the
    passages found. ``score`` is the best share of a passage's words, and at least a half with a base place.
    Null texts count as empty: no words, no labels, score 0. Every row of an id that repeats is scanned.
    """
    rows = listed(docs, templates, base, **keep)
    filed = index(document_counts(rows, vocabulary(templates)), templates)
    words, rare = F.col("words"), sorted({w for _, places in filed for w, _ in places})
    none = F.array().cast("array<int>")
    found = once(
        rows.select("keep", "n_words", "words", F.array_intersect("present", _strings(rare)).alias("found")),
        base=F.array(*[F.when(words.isNotNull(), _starts(words, phrase.split())).otherwise(none) for phrase, _ in base]),
        method=F.when(words.isNotNull(), _matches(words, F.col("found"), _index_column(filed))).otherwise(
            F.array().cast("array<struct<label:string,share:double>>")))
    places = F.flatten("base")
    own = F.array_compact(F.array(*[F.when(F.size(F.get("base", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(base)]))
    shown = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "keep.*", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        shown(own).alias("base_labels"), shown(F.concat(own, F.col("method.label"))).alias("labels"),
        F.greatest(F.coalesce(F.array_max("method.share"), F.lit(0.0)), F.when(F.size(places) > 0, BASE_SCORE).otherwise(0.0)).alias("score"))
