"""Product codes against plain loops; the walk along the trie against all distances."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayledger.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code string, position int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) and abs(x) < codes.LIMIT for x in v) and len(v) == 8]
    if not kept:
        return []
    width = 8 // parts
    cut = lambda v: [v[k * width:(k + 1) * width] for k in range(parts)]
    first = {}
    for i, v, _ in kept:
        key = (i is None, i or 0)
        first[key] = min(v, first.get(key, v))
    books = [[cut(first[k])[p] for k in sorted(first)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v)[p], books[p]), []).append(cut(v)[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        best = [near(cut(v)[p], books[p]) for p in range(parts)]
        coded.append((i, label, "".join(f"{e:02x}" for e in best), sum(far(cut(v)[p], books[p][e]) for p, e in enumerate(best))))
    total = {}
    for _, label, _, error in coded:
        total[label] = total.get(label, 0) + error
    return sorted((str(i), str(label), code, error, total[label], digest) for i, label, code, error in coded)


def odd_rows():
    rng = random.Random(9)
    rows = [(k, [rng.choice([-1, 1]) * rng.randrange(40) / 1000 for _ in range(8)], rng.choice([None, 0, 1, 2])) for k in range(3, 200)]
    rows += [(5, rows[0][1], 1), (5, rows[1][1], 1), (5, rows[1][1], 1), (None, rows[2][1], None), (None, rows[3][1], 0)]
    rows += [(0, None, 1), (1, [0.1] * 7 + [None], 1), (2, [float("nan")] * 8, 2), (-1, [float("inf")] + [0.0] * 7, 0), (-2, [], 0),
             (-3, [0.5] * 4, 0), (-4, [1e30] * 8, 0), (-5, [-0.0005] * 8, 0), (700, [12345.678] * 8, 3), (701, [-32767.5] * 8, 3)]
    return rows + [(800 + k, [0.02] * 8, 2) for k in range(120)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], SCHEMA).repartition(3)


def seen(df):
    return sorted((str(r.vec_id), str(r.label), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_against_loops(spark):
    rows = odd_rows()
    for parts, entries, rounds in ((4, 16, 4), (2, 256, 1), (1, 3, 2)):
        got = codes.compress(frame(spark, rows), F.col("embedding"), F.col("vec_id"), F.col("label"), parts, entries, rounds)
        assert seen(got) == brute(rows, parts, entries, rounds)


def test_no_rows_and_no_usable_vector(spark):
    for rows in ([], [(1, None, 2), (2, [float("nan")] * 8, None)]):
        df = codes.compress(frame(spark, rows), F.col("embedding"), F.col("vec_id"), F.col("label"))
        assert df.count() == 0 and df.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 60), st.integers(0, 1_000), st.sampled_from([1, 3, 50, 1 << 25]))
def test_walk_finds_the_nearest(width, entries, n, seed, reach):
    rng = np.random.default_rng(seed)
    parts = np.unique(rng.integers(-reach, reach + 1, (n, width)), axis=0)
    book = rng.integers(-reach, reach + 1, (entries, width))
    entry, error = codes.nearest(parts, book)
    all_far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, e, strict=True)) for e in book] for p in parts]
    assert entry.tolist() == [min(range(entries), key=lambda k: (d[k], k)) for d in all_far]
    assert error.tolist() == [min(d) for d in all_far]


def test_different_rows():
    rows = np.array([[2, 1], [0, 5], [2, 1], [0, -5], [2, 0]])
    leaves, place = codes.different(rows)
    assert leaves.tolist() == [[0, -5], [0, 5], [2, 0], [2, 1]] and (leaves[place] == rows).all()
