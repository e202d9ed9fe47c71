"""Fingerprints, links and components against brute force."""

import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from wayledger.llm import simhash
from wayledger.llm.components import components

from .cases import document_rows, documents, prose


def brute_fingerprint(text) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_near_duplicates_against_brute_force(spark):
    base = prose("en", 400, 70).split()
    rng = random.Random(3)
    near = []
    for k in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{k}"
        near.append((200 + k, " ".join(words), "en", "a"))
    rows = document_rows() + near
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {r[0:2]: brute_fingerprint(r[1]) for r in rows}
    distinct = set(fps.values())
    linked = [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 3]
    assert linked
    root, least = brute_roots(distinct, linked), {}
    for (i, _), fp in fps.items():
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    want = sorted((str(r[0]), fps[r[0:2]], str(least.get(root[fps[r[0:2]]]))) for r in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("segment_bits", [1, 2, 4])
def test_links_lose_no_pair(spark, segment_bits):
    rng = random.Random(segment_bits)
    fps = {rng.getrandbits(64) for _ in range(80)} | {0, (1 << 64) - 1, 1 << 63}
    for fp in list(fps):
        for flips in (1, 2, 3, 4):
            fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), segment_bits).distinct().collect()
    want = {tuple(sorted(p)) for p in combinations(signed, 2) if ((p[0] ^ p[1]) & ((1 << 64) - 1)).bit_count() <= 3}
    assert {(r.a, r.b) for r in found} == want


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(9)
    pairs = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(200)]
    for bits in (1, 2, 4):
        out = spark.createDataFrame(pairs, "a long, b long").select(
            "a", "b", simhash.embed(F.col("a"), bits).alias("x"), simhash.embed(F.col("b"), bits).alias("y")).collect()
        for r in out:
            fields = lambda v: [v >> s & ((1 << bits) - 1) for s in range(0, 32, bits)]
            assert fields(r.x) == [((r.a >> s) & ((1 << bits) - 1)).bit_count() for s in range(0, 32, bits)]
            assert sum(abs(p - q) for p, q in zip(fields(r.x), fields(r.y))) <= (r.a ^ r.b).bit_count()


def test_components_of_chains_hubs_and_repeats(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_representatives_keep_one_row_with_all_columns(spark):
    docs = documents(spark)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 2 copies 1; 4, 5, 6 and a null share fingerprint 0; 7 stands twice.
    assert ids.count("1") == 1 and "2" not in ids and ids.count("7") == 1 and "5" not in ids and "6" not in ids and ids.count("4") == 1
    assert simhash.representatives(docs.limit(0)).count() == 0
    assert [r.doc_id for r in simhash.representatives(documents(spark, [(None, "a b c", "x", "s"), (None, "a b c", "x", "t")])).collect()] == [None]
