"""Targets by hand, positions against brute force, cases that must not crash."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayledger.llm import mixing

from .cases import document_rows, documents


def brute_targets(sizes: dict, weights: dict, budget=1.5, most=2.0) -> dict:
    """Share, stop the full ones, share again."""
    left, open_ones, out = budget * sum(sizes.values()), set(sizes), {}
    while open_ones:
        total = sum(weights[s] for s in open_ones)
        full = {s for s in open_ones if left * weights[s] / total >= most * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / total for s in open_ones}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ones -= full
    return out


def size(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_assignment_against_brute_force(spark):
    got = mixing.assign(documents(spark)).select("row.source", "doc_id", "size", "source_size", "target", "taken", "positions").collect()
    rows = document_rows()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = brute_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    want, start = [], defaultdict(int)
    digest = lambda i: hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()
    for i, t, _, s in sorted(rows, key=lambda r: (r[3] is None, r[3] or "", digest(r[0]), r[0] is None, r[0] or 0, size(r[1]))):
        n = size(t)
        copies = sum(n > 0 and start[s] + e * sizes[s] + n / 2 <= goal[s] for e in (0, 1))
        start[s] += n
        want.append((str(i), n, sizes[s], round(goal[s], 6), n * copies))
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == sorted(want)
    for s in names:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - goal[s]) <= max(r["size"] for r in got if r.source == s) / 2 + 1
    assert all(r.taken <= 2 * r["size"] and all(0 <= p <= 1 for p in r.positions) for r in got)


@pytest.mark.parametrize("schedule", [(7.5, 2.5), (2.0, 2.0), (0.0, 1.0, 3.0), (4.0, 0.0)])
def test_inversion_undoes_the_integral(spark, schedule):
    weight = sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) / (len(schedule) - 1)

    def integral(t):
        width, total = 1 / (len(schedule) - 1), 0.0
        for k, (a, b) in enumerate(zip(schedule, schedule[1:])):
            x = min(max(t - k * width, 0), width)
            total += a * x + (b - a) * x * x / (2 * width)
        return total

    knots = F.array(*[F.lit(float(w)) for w in schedule])
    out = spark.range(0, 101).select((F.col("id") / 100).alias("share")).withColumn(
        "t", mixing._invert(mixing._segments(knots), F.lit(weight), F.col("share"))).collect()
    assert all(abs(integral(r.t) / weight - r.share) < 1e-9 for r in out)


def test_curriculum_is_in_order_and_repeats_itself(spark):
    docs = documents(spark)
    one, two = (mixing.mix(docs).collect() for _ in range(2))
    positions = [r["position"] for r in one]
    assert positions == sorted(positions)
    key = lambda rows: sorted(str(r) for r in rows)
    assert key(one) == key(two)
    assert max(r["pass"] for r in one) <= 1
    assert {c for c in docs.columns} <= set(one[0].asDict())


def test_heavy_source_fades(spark):
    rows = [(k, "word " * 20, "en", s) for k, s in enumerate("ab" * 300)]
    placed = mixing.mix(documents(spark, rows), schedules=((3.0, 1.0), (1.0, 3.0))).select("source", "position").collect()
    early = [r.source for r in placed if r.position < 0.25]
    late = [r.source for r in placed if r.position > 0.75]
    assert early.count("a") > 1.5 * early.count("b") and late.count("b") > 1.5 * late.count("a")


def test_empty_table_and_texts_without_words(spark):
    assert mixing.mix(documents(spark).limit(0)).count() == 0
    out = mixing.assign(documents(spark, [(1, None, None, None), (2, "", None, "a")])).collect()
    assert [(r.taken, r.positions) for r in out] == [(0, []), (0, [])]
