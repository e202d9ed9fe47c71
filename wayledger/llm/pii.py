"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail and network addresses, phone, card and account numbers, secrets and names.
Every distinct piece of them gets a keyed replacement of its own kind and form; rounds of checks keep
replacements distinct from each other and from everything real. The same piece has the same
replacement everywhere, so what referred to one person still does: a word of a name is replaced
wherever it stands in a text that has the name, also alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pseudonym import PlateHasher
from ..session import materialise
from .common import wrapped

# Titles tell a name and its gender.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "श्री")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "श्रीमती")
OTHER_TITLES = ("Dr", "Prof")
#: Given names by script and gender. They are recognised, and replacements are drawn from them.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "George", "Henry", "Ivan", "James", "John", "Karl", "Louis",
                     "Martin", "Michael", "Oscar", "Paul", "Pedro", "Robert", "Simon", "Thomas", "Victor", "William"),
    ("latin", "f"): ("Alice", "Anna", "Beatrice", "Clara", "Diana", "Elena", "Emma", "Frida", "Greta", "Helen", "Ida", "Jane", "Julia",
                     "Laura", "Lucía", "Maria", "Marie", "Nina", "Olga", "Rosa", "Sarah", "Sofia", "Vera"),
    ("cyrillic", "m"): ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Павел"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    ("devanagari", "m"): ("अर्जुन", "गणेश", "मोहन", "राजेश", "विजय", "सुरेश"),
    ("devanagari", "f"): ("अनिता", "गीता", "मीना", "राधा", "सीता", "सुनीता"),
}
#: What grows a given name when those of its list are taken, by script and gender.
_ENDINGS = {("latin", "m"): ("on", "ert", "in"), ("latin", "f"): ("ina", "ella", "ia"), ("cyrillic", "m"): ("он", "ир", "ей"),
            ("cyrillic", "f"): ("ина", "елла", "ия"), ("devanagari", "m"): ("राज", "देव", "नाथ"), ("devanagari", "f"): ("वती", "मती", "देवी")}

_NAME_WORD = r"[\p{Lu}\p{Lo}][\p{L}\p{M}'’]+(?:-\p{Lu}[\p{L}\p{M}'’]+)?"
_TITLES = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
_GIVEN = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
# Every pattern fails at its first letter nearly everywhere: words are entered at their beginning only
# and not given back, and what begins with a digit or a capital looks for that first.
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+"
_IPV4 = r"(?<![\d.])(?=\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
_CARD = r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"
_PHONE = (r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,5}(?:[ .\-]?\d{2,5}){1,4}(?!\d)"
          r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)")
_SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_ACCOUNT = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
_SECRET = r"(?<![\p{L}\d])(?=[0-9a-f])[0-9a-f]{32,}+(?![\p{L}\d])|(?<![\p{L}\d])(?:sk|pk|ghp|AKIA)[_\-]?[A-Za-z0-9]{16,}"
_LABELS = ("token", "secret", "passwd", "password", "api_key", "apikey")
_LABELLED = rf"""(?i:{"|".join(_LABELS)}) ?[=:] ?["']?[A-Za-z0-9+/_\-]{{8,}}"""
_CALLED = rf"(?<!\p{{L}})(?=[\p{{Lu}}\p{{Lo}}г])(?:(?:{_TITLES})\.? |(?:{_GIVEN}) )"
_NAME = (rf"(?<!\p{{L}})(?=[\p{{Lu}}\p{{Lo}}г])(?:(?:{_TITLES})\.? {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}"
         rf"|(?:{_GIVEN})(?: {_NAME_WORD}){{1,2}})")
#: Kinds in the order in which they are tried at a place.
KINDS = {"email": _EMAIL, "labelled": _LABELLED, "secret": _SECRET, "ip": _IPV4, "social": _SOCIAL, "card": _CARD, "phone": _PHONE,
         "account": _ACCOUNT, "name": _NAME}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Letters of which every entity without a digit has some; all found by plain search.
_SIGNS = ("@", "sk_", "sk-", "pk_", "pk-", "ghp_", "AKIA")
#: A run of letters, with single hyphens and apostrophes between them, or a run of anything else.
_RUN = r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*+|[^\p{L}\p{M}]+"
_PART = r"['’\-]|[^'’\-]+"
_JOINED = r"['’\-]"
#: What an apostrophe adds to a name, and one at its end.
_SUFFIX = r"['’]\p{L}{0,2}$"
#: After so many rounds a replacement is made longer to be distinct.
ROUNDS_IN_FORM = 6


def has_any(text: Column) -> Column:
    """Whether a text has an entity. Most texts are told apart by cheap signs, and only the rest is searched."""
    sign = text.rlike("[0-9]")
    for found in _SIGNS:
        sign = sign | F.contains(text, F.lit(found))
    for label in _LABELS:
        sign = sign | F.contains(F.lower(text), F.lit(label))
    return F.coalesce((sign | text.rlike(_CALLED)) & text.rlike(ANY), F.lit(False))


def kind_of(value: Column) -> Column:
    """The kind of a found entity: the first whose pattern is the whole of it."""
    kind = F.lit("name")
    for name, pattern in list(KINDS.items())[::-1]:
        kind = F.when(value.rlike(rf"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsDevanagari}"), "devanagari").otherwise("latin")


def pieces(kind: Column, value: Column) -> Column:
    """The pieces of an entity in order: (kind, text, keep). Names fall into words, so that a family
    name alone is replaced as in the whole name; a title is kept and tells the gender. The label of a
    secret is kept, too."""
    words = F.split(value, " ")
    male, female = (F.array(*[F.lit(t) for t in ts]) for ts in (MALE_TITLES, FEMALE_TITLES))
    bare = lambda w: F.rtrim(w, F.lit("."))
    first = bare(F.element_at(words, 1))
    titled = F.array_contains(F.array(*[F.lit(t) for t in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)]), first)
    by_title = F.when(F.array_contains(male, first), "m").when(F.array_contains(female, first), "f")
    lists = {g: F.array(*[F.lit(n) for (s, x), names in GIVEN.items() if x == g for n in names]) for g in "mf"}
    by_name = lambda w: F.when(F.array_contains(lists["m"], w), "m").when(F.array_contains(lists["f"], w), "f")
    start = F.when(titled, 2).otherwise(1)

    def named(w: Column, i: Column) -> Column:
        place = i + 1
        is_given = (place < F.size(words)) | by_name(w).isNotNull()
        gender = F.coalesce(by_name(w), by_title, F.lit("m"))
        sort = F.when(place < start, "title").when(is_given, F.concat_ws("_", F.lit("given"), gender, _script(w))).otherwise("family")
        return F.struct(sort.alias("kind"), w.alias("text"), (place < start).alias("keep"))

    secret = F.regexp_extract(value, r"[A-Za-z0-9+/_\-]+$", 0)
    labelled = F.array(F.struct(F.lit("label").alias("kind"), F.substring(value, F.lit(1), F.length(value) - F.length(secret)).alias("text"), F.lit(True).alias("keep")),
                       F.struct(F.lit("secret").alias("kind"), secret.alias("text"), F.lit(False).alias("keep")))
    return F.when(kind == "name", F.transform(words, named)).when(kind == "labelled", labelled).otherwise(
        F.array(F.struct(kind.alias("kind"), value.alias("text"), F.lit(False).alias("keep"))))


def _stream(hasher: PlateHasher, seed: Column, length: Column) -> Column:
    """At least ``2 * length`` hex digits that depend on the key and the seed."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")),
                                    lambda b: hasher.hash(F.concat_ws(":", b.cast("string"), seed))), "")


def _number(stream: Column, start: Column | int, digits: int) -> Column:
    at = start if isinstance(start, Column) else F.lit(start)
    return F.conv(F.substring(stream, at, F.lit(digits)), 16, 10).cast("long")


def _in_form(text: Column, stream: Column) -> Column:
    """Each letter by a letter of its case and script, each digit by a digit, a leading digit other than 0 by such; the rest stays.

    Lower-case hexadecimal stays hexadecimal.
    """
    hexadecimal = text.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}$")

    def drawn(c: Column, i: Column) -> Column:
        n = _number(stream, i * 2 + 1, 2)
        letter = lambda first, many: F.char(F.lit(first) + n % many)
        wide = lambda first, many: F.decode(F.unhex(F.lpad(F.hex(F.lit(first) + n % many), 4, "0")), "UTF-16BE")
        return (F.when(hexadecimal, F.lower(F.hex(n % 16)))
                .when(c.rlike("[1-9]") & (i == 0), (n % 9 + 1).cast("string"))
                .when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), wide(0x410, 32))
                .when(c.rlike(r"\p{IsCyrillic}"), wide(0x430, 32))
                .when(c.rlike(r"\p{IsGreek}") & c.rlike(r"\p{Lu}"), wide(0x391, 17))
                .when(c.rlike(r"\p{IsGreek}"), wide(0x3B1, 17))
                .when(c.rlike(r"\p{IsDevanagari}") & c.rlike(r"\p{Lo}"), wide(0x915, 37))
                .when(c.rlike(r"\p{IsHan}"), wide(0x4E00, 256))
                .when(c.rlike(r"\p{Lu}"), letter(65, 26))
                .when(c.rlike(r"\p{Ll}"), letter(97, 26))
                .otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), drawn), "")


def _luhn(digits: Column) -> Column:
    """Check sum of a string of digits, modulo 10."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10


def _card_like(text: Column, drawn: Column) -> Column:
    """A valid card number becomes a valid one: the last digit is set by the others."""
    plain = lambda c: F.regexp_replace(c, r"\D", "")
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (10 - _luhn(F.concat(plain(body), F.lit("0")))) % 10
    return F.when(_luhn(plain(text)) == 0, F.concat(body, check.cast("string"))).otherwise(drawn)


def surrogate(hasher: PlateHasher, kind: Column, text: Column, round_no: int) -> Column:
    """The replacement that a piece is offered in a round."""
    stream = _stream(hasher, F.concat_ws(":", kind, text, F.lit(str(round_no))), F.length(text))
    form = _in_form(text, stream)
    local, domain = F.split_part(text, F.lit("@"), F.lit(1)), F.split_part(text, F.lit("@"), F.lit(2))
    at = F.length(local)
    email = F.concat(F.substring(form, F.lit(1), at), F.lit("@"),
                     F.split_part(F.substring(form, at + 2, F.length(domain)), F.lit("."), F.lit(1)), F.lit(".example."),
                     F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (_number(stream, 1, 4) % 3 + 1).cast("int")))
    octet = lambda k: (_number(stream, 1 + 4 * k, 4) % 254 + 1).cast("string")
    # Calling codes stay: they say where a number is from.
    code = F.regexp_extract(text, r"^\+\d{1,3}(?=[ .\-(])", 0)
    phone = F.concat(code, F.substring(form, F.length(code) + 1, F.length(text)))
    given: Column = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), (_number(stream, 1, 6) % len(names) + 1).cast("int"))
        ends = F.array(*[F.lit(e) for e in _ENDINGS[script, gender]])
        grown = F.concat(pick, *[F.element_at(ends, (_number(stream, 7 + 4 * k, 4) % 3 + 1).cast("int")) for k in range(round_no)])
        given = F.when(kind == f"given_{gender}_{script}", grown).otherwise(given)
    made = (F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *[octet(k) for k in range(4)]))
            .when(kind == "card", _card_like(text, form)).when(kind == "phone", phone)
            .when(kind.startswith("given"), given).otherwise(form))
    if round_no >= ROUNDS_IN_FORM:
        made = F.concat(made, F.upper(F.substring(stream, 1, round_no)))
    return made


def assign(found: DataFrame, hasher: PlateHasher) -> DataFrame:
    """(kind, text, surrogate) for distinct pieces (kind, text).

    Each round offers every open piece a replacement. It is refused if a real piece of any kind reads
    the same, if it has been given away, or if another piece of the round is offered the same and
    comes first in order. Refused pieces go to the next round. Pieces of one kind and of all kinds
    thus never share a replacement. A round is written to the shared folder.
    """
    # Few bytes, much work for each: spread by number, not by size.
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = materialise(found.select("kind", "text").distinct())
    given, open_pieces, round_no = None, real, 0
    while True:
        offered = open_pieces.repartition(parts, "text").withColumn("surrogate", surrogate(hasher, F.col("kind"), F.col("text"), round_no)) \
            .join(real.select(F.col("text").alias("surrogate")).distinct(), "surrogate", "left_anti")
        if given is not None:
            offered = offered.join(given.select("surrogate"), "surrogate", "left_anti")
        won = materialise(offered.groupBy("surrogate").agg(F.min(F.struct("kind", "text")).alias("piece"))
                          .select("piece.kind", "piece.text", "surrogate"))
        given = won if given is None else given.unionByName(won)
        open_pieces = materialise(open_pieces.join(won, ["kind", "text"], "left_anti"))
        round_no += 1
        if open_pieces.isEmpty():
            return given


def replaced(docs: DataFrame, hasher: PlateHasher) -> DataFrame:
    """(row, text, n_entities): every row, its text with surrogates.

    ``n_entities`` counts what the pattern finds. Words of names that stand alone elsewhere in the
    same text are replaced as in the name, and not counted.

    ``row`` holds all columns of the input. Texts without an entity pass as they are and are not
    moved. The others are searched once per distinct text; entities travel without their texts. Null
    and empty texts stay so. Repeated rows are replaced alike. The same key gives the same result
    for the same table; a piece may get another replacement if the table's other pieces change.
    """
    text = F.col("text").cast("string")
    rows = wrapped(docs, text=text)
    touched = has_any(F.col("text"))
    with_any = rows.where(touched).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    matches = F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))
    entities = materialise(
        with_any.select("digest", F.posexplode(matches).alias("place", "value"))
        .groupBy("digest", "place").agg(F.min("value").alias("value"))
        .withColumn("kind", kind_of(F.col("value"))))
    parts = (entities.groupBy("kind", "value").agg(F.count("*").alias("n")).select("kind", "value", F.posexplode(pieces(F.col("kind"), F.col("value"))).alias("at", "piece"))
             .select("value", F.col("kind").alias("whole"), "at", "piece.*"))
    parts = materialise(parts)
    names = assign(parts.where("not keep").select("kind", "text"), hasher)
    in_order = lambda: F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("surrogate", "text").alias("shown")))), lambda x: x["shown"])
    shown = (parts.join(names, ["kind", "text"], "left").groupBy("whole", "value").agg(in_order().alias("all"))
             .withColumn("surrogate", F.when(F.col("whole") == "name", F.array_join("all", " ")).otherwise(F.array_join("all", ""))))
    by_text = (entities.join(shown, (entities["value"] == shown["value"]) & (entities["kind"] == shown["whole"])).groupBy("digest")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "surrogate"))), lambda x: x["surrogate"]).alias("surrogates")))
    # Whole names alone tell which words of a text are names; the first use of a word decides.
    named = F.col("piece.kind").isin("family", *[f"given_{g}_{script}" for script, g in GIVEN])
    words = (entities.where("kind = 'name'").select("digest", F.col("value"), "place").join(
        parts.where("whole = 'name' and not keep").select("value", "at", F.struct("kind", "text").alias("piece")), "value")
        .where(named & (F.char_length("piece.text") > 1)).select("digest", "place", "at", "piece.*").join(names, ["kind", "text"]))
    stem = F.regexp_replace("text", _SUFFIX, "")
    both = words.select("digest", F.explode(F.array(
        F.struct(F.lit(0).alias("stem"), "place", "at", F.col("text").alias("word"), "surrogate"),
        F.struct(F.lit(1).alias("stem"), "place", "at", stem.alias("word"), F.regexp_replace("surrogate", _SUFFIX, "").alias("surrogate")))).alias("w"))
    by_word = both.groupBy("digest", "w.word").agg(F.min(F.struct("w.stem", "w.place", "w.at", "w.surrogate"))["surrogate"].alias("surrogate"))
    known = by_word.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("word", "surrogate"))).alias("known"))
    by_text = by_text.join(known, "digest", "left")
    own = lambda w: F.coalesce(F.element_at("known", w), w)
    part_by_part = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(_PART), F.lit(0)), own), "")
    belonging = lambda w: F.concat(F.element_at("known", F.regexp_replace(w, _SUFFIX, "")), F.regexp_extract(w, _SUFFIX, 0))
    alone = lambda w: F.coalesce(F.element_at("known", w), F.when(w.rlike(_JOINED), F.coalesce(belonging(w), part_by_part(w))).otherwise(w))
    later = lambda t: F.when(F.col("known").isNull(), t).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_RUN), F.lit(0)), alone), ""))
    between = F.transform(F.split(F.col("text"), ANY, -1), later)
    joined = F.array_join(F.zip_with(between, F.concat("surrogates", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = with_any.join(by_text, "digest").select("row", joined.alias("text"), F.size("surrogates").alias("n_entities"))
    return changed.unionByName(rows.where(~touched).select("row", "text", F.lit(0).alias("n_entities")))


def pseudonymised(docs: DataFrame, hasher: PlateHasher) -> DataFrame:
    """The rows with their text replaced; a column ``n_chars`` is counted anew, other columns stay."""
    out = replaced(docs, hasher)
    made: dict[str, Callable[[], Column]] = {"text": lambda: F.col("text"), "n_chars": lambda: F.char_length("text").cast("long")}
    return out.select(*[made[c]().alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
