"""Edits and likeness against plain sets, near-duplicates against all pairs."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import minhash
from wayledger.session import materialise, small_batches

from .cases import document_rows, documents, prose


def runs(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_fingerprints_against_brute_force(spark, parts):
    rows = document_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = minhash.fingerprints(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[:len(t) - third] + n[:third]
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(runs(t), runs(e)), jaccard(runs(t), runs(n))))
    key = lambda r: r[:3]
    have = sorted([(str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) for r in got], key=key)
    want.sort(key=key)
    assert [h[:3] for h in have] == [w[:3] for w in want]
    assert all(abs(h[3] - w[3]) < 0.25 and abs(h[4] - w[4]) < 0.25 for h, w in zip(have, want))
    assert sum(abs(h[3] - w[3]) for h, w in zip(have, want)) / len(want) < 0.06
    by_text = {}
    texts = {(str(i), t or "") for i, t, *_ in rows}
    for h in have:
        for i, t in texts:
            if i == h[0] and len(t) == h[1] and i not in ("None", "11"):
                assert by_text.setdefault(t, h[5]) == h[5]


def test_one_document_and_none(spark):
    one = minhash.fingerprints(documents(spark, [(5, "a b c d e f", "en", "s")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    assert minhash.fingerprints(documents(spark).limit(0)).count() == 0


def edited_rows():
    """Copies of a text with up to 12 other words, a chain of steps, and exact copies."""
    rng = random.Random(7)
    rows = []
    for g in range(6):
        base = [f"{w}{rng.randrange(99)}" for w in prose("de", 250, 300 + g).split()]
        for k in range(12):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = f"y{rng.randrange(9999)}"
            rows.append((1000 * g + 900 - k, " ".join(words), "de", "a"))
        rows += [(1000 * g + 800 + k, " ".join(base), "de", "b") for k in range(5)]
    chain = [f"c{k}" for k in range(400)]
    return rows + [(9000 + k, " ".join(chain[25 * k:25 * k + 300]), "de", "c") for k in range(4)] + document_rows()


def brute_groups(rows):
    """Each text's group over sets that are linked at 0.8, and the least id of each group, or None."""
    sets = sorted({frozenset(runs(t)) for _, t, *_ in rows}, key=sorted)
    root = {s: s for s in sets}
    for a, b in combinations(sets, 2):
        if a and b and jaccard(a, b) >= 0.8 and root[a] != root[b]:
            old = root[b]
            root = {s: root[a] if r == old else r for s, r in root.items()}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            r = root[frozenset(runs(t))]
            least[r] = min(i, least.get(r, i))
    return (lambda t: root[frozenset(runs(t))]), least


def test_edited_copies_leave_one_row(spark):
    rows = edited_rows()
    group, least = brute_groups(rows)
    docs = documents(spark, rows)
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    want = sorted(str(least.get(g)) for g in {group(t) for _, t, *_ in rows})
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert minhash.representatives(docs.limit(0)).count() == 0


def test_query_tells_classes_and_groups(spark):
    rows = edited_rows()
    group, least = brute_groups(rows)
    classes = {}
    for i, t, *_ in rows:
        if i is not None:
            key = frozenset(runs(t))
            classes[key] = min(i, classes.get(key, i))
    got = minhash.fingerprints_and_groups(documents(spark, rows)).collect()
    want = sorted((str(i), len(t or ""), str(classes.get(frozenset(runs(t)))), str(least.get(group(t)))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_chars, str(r.class_id), str(r.near_id)) for r in got) == want
    assert minhash.fingerprints_and_groups(documents(spark).limit(0)).count() == 0


def test_recall_where_unlike_texts_share_bands(spark):
    """Texts of a common half, some of them edited copies of another: bands hold many unlike texts."""
    rng = random.Random(12)
    common = [f"k{k}" for k in range(140)]
    rows = []
    for g in range(120):
        own = [f"g{g}w{k}" for k in range(60)]
        for c in range(3):
            words = common + own
            for _ in range(c * rng.randrange(1, 3)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9_999)}"
            rows.append((10 * g + c, " ".join(words), "en", "a"))
    group, least = brute_groups(rows)
    want = {i: least[group(t)] for i, t, *_ in rows}
    got = {r.doc_id: r.near_id for r in minhash.fingerprints_and_groups(documents(spark, rows)).collect()}
    assert all(least[group(t)] <= got[i] for i, t, *_ in rows)  # nothing is joined that no link joins
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert len(set(want.values())) > 60


def test_no_leader_hides_a_link(spark):
    """Near copies whose bands hold hundreds of texts that are almost as alike: each finds its own other."""
    rng, rows = random.Random(5), []
    for g in range(200):
        base = [f"k{k}" for k in range(176)] + [f"g{g}w{k}" for k in range(24)]  # 0.78 alike
        other = list(base)
        for place in rng.sample(range(6, 170, 6), 4):  # 0.81 alike
            other[place] = f"e{g}p{place}"
        rows += [(2 * g, " ".join(base), "en", "a"), (2 * g + 1, " ".join(other), "en", "a")]
    got = {r.doc_id: r.near_id for r in minhash.fingerprints_and_groups(documents(spark, rows)).collect()}
    assert {i: n for i, n in got.items() if n != i - i % 2} == {} and len(got) == 400


def test_few_unlike_pairs_leave_the_join(spark):
    """Texts of one base with so many edits that none is like another: hardly a pair is left to compare, no link is lost."""
    rng, rows = random.Random(3), []
    for g in range(150):
        words = [f"k{k}" for k in range(150)]
        for k, place in enumerate(rng.sample(range(4, 146, 6), 5 if g % 10 else 1)):  # other texts hold these words too
            words[place] = f"e{g % 50}p{k}"
        rows.append((g, " ".join(words), "en", "a"))
    docs = documents(spark, rows)
    opened = minhash.marked(docs).select(F.col("doc_id").alias("node"), "n", F.col("doc_id").alias("root"), "digest")
    found = {(r.a, r.b) for r in minhash.sharing(docs, opened).collect()}
    sets = {i: runs(t) for i, t, *_ in rows}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.8}
    assert len(want) > 50 and want <= found
    assert len(found) <= 2 * len(want)


def test_parities_never_tell_more_than_the_difference():
    rng = random.Random(4)
    for n in (0, 1, 40, 3_000):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = {x for x in a if rng.random() < 0.7} | {rng.getrandbits(64) for _ in range(n // 5)}
        odd = [minhash.parities(np.array(sorted(s), np.uint64)) for s in (a, b)]
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*odd, strict=True)) <= len(a ^ b)


def test_python_gets_few_texts_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = spark.range(2_500).coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long")
    with small_batches(spark):
        assert materialise(sizes).count() == 3
    assert spark.conf.get(key) == before
