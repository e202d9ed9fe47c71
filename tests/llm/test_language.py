from wayledger.llm import language

from .cases import WORDS, document_rows, documents, prose


def test_language_by_compression(spark):
    docs = documents(spark)
    model = language.learn(docs)
    assert set(model.dictionaries) == set(WORDS)
    fresh = [(k, prose(lang, 25, 1000 + k), lang, "s") for k in range(30) for lang in WORDS]
    held = documents(spark, fresh)
    out = language.classify(held, model, doc_id=held["doc_id"], lang=held["lang"]).collect()
    assert len(out) == len(fresh)
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_texts_without_letters_are_undetermined(spark):
    docs = documents(spark)
    out = language.classify(docs, language.learn(docs), text=docs["text"]).collect()
    assert len(out) == len(document_rows())
    for r in out:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") != letters
        assert letters or (r.score == 0 and not r.accepted)


def test_narrow_margins_are_rejected(spark):
    half = prose("en", 40, 1) + " " + prose("de", 40, 2)
    docs = documents(spark)
    model = language.learn(docs)
    both = documents(spark, [(1, half, None, None), (2, prose("en", 80, 3), None, None)])
    strict = {r.doc_id for r in language.accepted_only(both, model, min_margin=0.3).collect()}
    assert strict == {2}
    assert language.accepted_only(both, model).columns == both.columns


def test_nothing_learned_and_nothing_to_tell(spark):
    docs = documents(spark)
    empty = language.learn(docs.where("lang is null"))
    assert {r.lang_pred for r in language.classify(docs, empty).collect()} == {"und"}
    assert language.classify(docs.limit(0), language.learn(docs)).count() == 0
    one = language.learn(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language.classify(docs, one).collect()} == {"und", "de"}


def test_short_clean_texts_are_decided(spark):
    docs = documents(spark)
    model = language.learn(docs)
    short = documents(spark, [(k, prose(lang, 3 + k % 3, 5000 + k), lang, "s") for k in range(40) for lang in WORDS])
    out = language.classify(short, model, lang=short["lang"]).collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.9
    assert sum(r.accepted for r in out) / len(out) > 0.97


def test_long_texts_teach_in_equal_parts(spark):
    """No text is short, and two fill a dictionary: each of them still takes part, in whole words."""
    rows = [(k, " ".join(f"{prose(lang, 1, j)}{chr(97 + k)}" for j in range(9_000)), lang, "s") for k in range(5) for lang in WORDS]
    rows += [(90, "1 " * 30_000 + "только эти слова", "ru", "s")]
    docs = documents(spark, rows)
    model = language.learn(docs)
    assert set(model.dictionaries) == {*WORDS, "ru"}
    whole = {lang: {w for _, t, x, _ in rows if x == lang for w in language.fold(t).split()} for lang in model.dictionaries}
    for lang, content in model.dictionaries.items():
        words = content.decode().split()
        assert set(words) <= whole[lang] and len(content) <= language.DICTIONARY_BYTES
        if lang != "ru":
            ends = [w[-1] for w in words]
            assert all(ends.count(c) > len(ends) / 10 for c in "abcde") and len(content) > language.DICTIONARY_BYTES * 0.99
    assert model.dictionaries["ru"].decode() == "только эти слова"


def test_filled_shares_the_room():
    assert language.filled(["aa bb cc", "d", "ee ff gg"], 13) == b"aa bb d ee ff"
    assert language.filled(["aa bb", "d"], 100) == b"aa bb d" and language.filled([], 100) == b""
    assert language.filled(["я" * 9], 5).decode() == "яя"
