"""Snapshots against brute force."""

from wayledger.llm import chat

ROWS = [(c, t, r, x) for c, turns in {
    1: [(0, "user", "hi")], 2: [(0, "user", "hi"), (1, "assistant", "yes")], 3: [(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "so")],
    4: [(0, "user", "hi"), (1, "assistant", "no")], 5: [(0, "user", "hi"), (1, "assistant", "no")], 6: [(1, "user", "hi")],
    7: [(0, "system", "<|im_end|>"), (0, "user", "tie"), (0, "user", "tie")], 8: [(None, None, None), (3, "user", None)],
    None: [(0, "user", "lost"), (1, "assistant", "")], 9: [(k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(700)],
    10: [(k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(300)],
    11: [(0, "user", "x" * 200_000)], 12: [(-5, "user", "early"), (0, "assistant", "late")], 13: [(-5, "user", "early")],
}.items() for t, r, x in turns]


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((-(1 << 63) if t is None else t, r or "", x or ""))
    convs = {c: sorted(v) for c, v in convs.items()}

    def is_beginning(a, b):
        return len(a) < len(b) and a == [x for x in b if x[0] <= a[-1][0]]

    out = []
    for c, v in convs.items():
        if any(is_beginning(v, w) for w in convs.values()):
            continue
        same = sorted((k for k, w in convs.items() if w == v), key=lambda k: (k is None, k or 0))
        if same[0] == c:
            shown = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{x.replace('<|', '< |')}<|im_end|>\n" for _, r, x in v)
            out.append((str(c), len(v), len(same), shown))
    return sorted(out)


def test_rendered_conversations_against_brute_force(spark):
    data = spark.createDataFrame([(*r, "x", 1) for r in ROWS * 2], "conv_id long, turn long, role string, text string, key string, n long")
    got = chat.render(data.repartition(5)).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.n_copies, r.text) for r in got) == brute(ROWS)
    assert chat.maximal(data).count() == len(got)


def test_flood_of_copies_and_empty_table(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(500) for t in range(3)] + [(c, t, "user", f"t{t}") for c in range(500, 900) for t in range(2)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in chat.render(data).collect()] == [(0, 3, 500)]
    assert chat.render(data.limit(0)).count() == 0
