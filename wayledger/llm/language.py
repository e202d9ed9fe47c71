"""Language identification by compression.

Each language has a raw-content dictionary of texts in it. A text is compressed with every
dictionary in turn; the language whose dictionary makes it smallest is the language of the text. If
the second is hardly larger, the decision is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

UNDETERMINED = "und"
#: Bounds of what is learned from: so many texts a language, and a passage of at most so many characters of each.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 16_000
#: Bytes of a dictionary, and of the pieces that a text is compressed in, so that the dictionary stays near.
DICTIONARY_BYTES = 65_536
PIECE_BYTES = 2_048
LEVEL = 6
#: Texts below so many bytes are weighed by their runs of so many words as well.
SHORT_BYTES = 512
SHORT_RUNS = (1, 2, 3)
REPEATED_BYTES = 64
#: A decision counts if the best saves so much of the second's size.
MIN_MARGIN = 0.004
#: Bytes by which a language must be behind to be e times less likely.
SCALE = 4.0

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Words in lower case, one space apart: case, digits and punctuation say little about a language."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip()


@dataclass
class Model:
    """Dictionaries by language, the language with the most labelled texts first."""

    dictionaries: dict[str, bytes]


def filled(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """The beginnings of the texts, one space apart, in ``size`` bytes: as much of each as fits them all, cut between words."""
    data = [t.encode("utf-8", "surrogatepass") for t in dict.fromkeys(texts)]
    room, share = size + 1, 0
    for k, n in enumerate(sorted(map(len, data))):
        share = room // (len(data) - k)
        if n >= share:
            break
        room -= n + 1
    else:
        share = size + 2

    def cut(t: bytes) -> bytes:
        if len(t) < share:
            return t
        head = t[:share - 1]
        # A text without spaces is cut between characters.
        return head if t[len(head):len(head) + 1] == b" " else head.rpartition(b" ")[0] or head.decode("utf-8", "ignore").encode()

    return b" ".join(filter(None, map(cut, data)))[:size]


def learn(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries from (text, lang): of each language the texts with the smallest digests.

    A longer text than ``sample_chars`` gives a passage of that length, at a place that its digest
    tells. At most ``sample_texts * sample_chars`` characters a language reach the driver; the texts
    are chosen before the shuffle. All chosen texts share the dictionary. Rows without text, letters
    or language teach nothing.
    """
    known = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    first = Window.partitionBy("lang").orderBy("digest", "passage")
    spare = F.greatest(F.char_length("text") - sample_chars, F.lit(0))
    start = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % (spare + 1) + 1
    there = F.substring(F.col("text"), start.cast("int"), F.lit(sample_chars))
    # A place without letters gives way to the text's first letters.
    lettered = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{sample_chars - 1}}}", 0)
    rows = (known.where(F.col("text").rlike(r"\p{L}"))
            .withColumn("digest", F.md5(F.col("text").cast("binary")))
            .select("lang", "digest", (spare > 0).alias("cut"), ((spare > 0) & (start > 1) & there.rlike(r"\p{L}")).alias("inside"),
                    F.when(there.rlike(r"\p{L}"), there).otherwise(lettered).alias("passage"))
            .withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample_texts)
            .select("lang", "place", "passage", "inside", "cut").collect())
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        folded = fold(r["passage"])
        # The first and the last word of a passage from inside a text are parts of words.
        if r["inside"]:
            folded = folded.partition(" ")[2] or folded
        if r["cut"] and len(r["passage"]) == sample_chars:
            folded = folded.rpartition(" ")[0] or folded
        texts.setdefault(r["lang"], []).append(folded)
    return Model({lang: filled(texts[lang]) for lang in sorted(texts, key=lambda x: (-counts[x], x))})


def compressors(model: Model) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in model.dictionaries.items():
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=PIECE_BYTES, dict_size=max(len(content), 8), write_content_size=0)
        data.precompute_compress(compression_params=settings)
        made.append((lang, zstandard.ZstdCompressor(dict_data=data, compression_params=settings)))
    return made


def pieces_of(folded: str) -> list[bytes]:
    """A text cut into pieces. A short one is weighed by its runs of a few words as well: whole bytes
    tell little about it, and the sum over its runs tells more.

    Runs are repeated: a few bytes alone would be stored as they are, dictionary or not, while the
    repeats cost the same with every dictionary and leave what the first copy saves to be seen.
    """
    data = f" {folded} ".encode("utf-8", "surrogatepass")
    if len(data) >= SHORT_BYTES:
        return [data[k:k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES)]
    words = data.split()
    runs = [data, *(b" " + b" ".join(words[k:k + n]) + b" " for n in SHORT_RUNS for k in range(max(len(words) - n + 1, 0)))]
    return [run * (1 + -(-REPEATED_BYTES // len(run))) for run in runs]


def decide(text: str | None, made: list[tuple[str, zstandard.ZstdCompressor]], min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    """(language, score, margin, accepted). Ties go to the language with more labelled texts and are rejected."""
    if not made or text is None or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, False
    pieces = pieces_of(fold(text))
    sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in made]
    best = min(sizes)
    winner = sizes.index(best)
    rest = sizes[:winner] + sizes[winner + 1:]
    margin = (min(rest) - best) / min(rest) if rest else 1.0
    score = 1.0 / sum(math.exp(-(s - best) / SCALE) for s in sizes)
    return made[winner][0], score, margin, margin >= min_margin


def classify(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN, **keep: Column) -> DataFrame:
    """The ``keep`` columns, lang_pred, score, margin and accepted for every row of (text).

    Only the whole text decides. Null texts and texts without a letter are ``und``, with score 0, and
    not accepted; so is all if nothing was learned. No row is moved.
    """
    # Plain values only: a worker need not have this module.
    shared = docs.sparkSession.sparkContext.broadcast(model.dictionaries)
    names = [*keep, "lang_pred", "score", "margin", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors(Model(shared.value))
        for batch in batches:
            lang, score, margin, accepted = zip(*(decide(t.as_py(), made, min_margin) for t in batch.column(0)), strict=True) \
                if batch.num_rows else ((),) * 4
            yield pa.record_batch([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                   pa.array(margin, pa.float64()), pa.array(accepted, pa.bool_())], names)

    slim = docs.select(F.col("text").cast("string").alias("__text"), *[c.alias(k) for k, c in keep.items()])
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType()),
             StructField("accepted", BooleanType())]
    return slim.mapInArrow(run, StructType([*slim.schema.fields[1:], *added]))


def accepted_only(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language was decided, with the columns they came with."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return classify(docs, model, min_margin, row=whole).where("accepted").select("row.*")
