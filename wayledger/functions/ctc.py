"""Token-sequence functions over recogniser output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata as R
from .literals import constant_array, constant_map


def greedy_indices(log_probs: Column) -> Column:
    """Best class per timestep, repeats dropped, blanks dropped."""
    best = F.transform(log_probs, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))
    return collapse(best)


def collapse(indices: Column) -> Column:
    """Drop repeats, then blanks (index 0)."""
    kept = F.filter(
        F.zip_with(
            indices,
            F.slice(F.concat(F.array(F.lit(-1)), indices), 1, F.size(indices)),
            lambda cur, prev: F.when((cur != prev) & (cur != 0), cur),
        ),
        lambda x: x.isNotNull(),
    )
    return kept


def tokens(indices: Column, vocabulary: list[str] | None = None) -> Column:
    """Vocabulary tokens of class indices."""
    vocab = constant_array(vocabulary or R.vocabulary())
    return F.transform(indices, lambda i: F.element_at(vocab, (i + 1).cast("int")))


def token_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over whole tokens: each token becomes one character.

    Tokens outside the vocabulary are numbered within the pair, so different ones stay different.
    """
    table = constant_map({t: chr(0xE000 + i) for i, t in enumerate(R.vocabulary())})
    both = F.array_distinct(F.concat(a, b))

    def other(t: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(F.lit(0x4E00) + F.array_position(both, t)), 4, "0")), "UTF-16BE")

    def encoded(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda t: F.coalesce(F.try_element_at(table, t), other(t))), "")

    return F.levenshtein(encoded(a), encoded(b))


def geometric_mean_score(token_log_probs: Column) -> Column:
    """exp of the mean log-probability; 0 for an empty sequence."""
    total = F.aggregate(token_log_probs, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(token_log_probs)
    return F.when(n > 0, F.exp(total / n)).otherwise(0.0)
