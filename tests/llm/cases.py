"""Rows that every operator must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, fp string, score string, position string, "
          "spans string, items string, digest string, row string, key string, toxic string, place string, page_id string, range string")

WORDS = {
    "en": "the of and that with have this from they which there would about people into after".split(),
    "de": "der und nicht werden schön über größe haben eine auch wieder zwischen können möchte durch straße".split(),
    "fr": "les être dans pour avec très où était même après leçon français voilà quelque chose depuis".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", ".", ","]) for _ in range(n))


def document_rows() -> list[tuple]:
    rows = [
        (1, prose("en", 40, 1), "en", "a"), (2, prose("en", 40, 1), "en", "a"), (3, prose("de", 60, 2), "de", "b"),
        (4, None, "en", "a"), (5, "", "en", None), (6, "   \n\t ", None, "b"), (7, prose("fr", 50, 3), "fr", None),
        (7, prose("fr", 50, 3), "fr", None), (None, prose("en", 30, 4), None, "c"), (None, None, None, None),
        (9, prose("en", 20_000, 5), "en", "a"), (10, "12345 !!! ???", "en", "c"), (11, "one", "en", "c"), (11, "two", "en", "c"),
        (-3, prose("de", 35, 6), "de", "b"), (12, "naïve   ÄÖ 𝒳𝒴 中文 \x00 end", "de", "b"),
    ]
    rows += [(100 + i, prose(lang, 30 + i, i), lang, "abc"[i % 3]) for i in range(20) for lang in WORDS]
    return rows


def documents(spark, rows=None):
    rows = document_rows() if rows is None else rows
    wide = [(i, t, lang, s, None if t is None else len(t), *["x"] * 13) for i, t, lang, s in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3, "lang")
