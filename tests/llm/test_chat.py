"""Snapshot collapse against comparing all conversations."""

import random

from freshet.llm import chat


def plain(rows):
    talks = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, (v[2] or "").encode(), (v[3] or "").encode())):
        talks.setdefault(c, []).append((r or "", x or ""))
    out = []
    for c, t in talks.items():
        same = [d for d, u in talks.items() if u == t]
        if any(len(u) > len(t) and u[: len(t)] == t for u in talks.values()):
            continue
        best = min((d for d in same if d is not None), default=None)
        if c == best:
            out.append((c, len(t), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)))
    return sorted(out, key=repr)


def test_snapshots_copies_and_edges(spark):
    rng = random.Random(6)
    rows = []
    for c in range(150):
        base = rng.randrange(12)
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {base} {t}" if rng.random() < 0.95 else "other"))
    rows += [(500, None, None, None), (500, 0, "user", ""), (501, 0, None, None), (502, 1, "user", "x"), (502, 1, "user", "x"), (None, 0, "user", "no id"), (None, 1, "a", "b")]
    rows += [(503, 0, "user", "long " * 20_000), (504, 0, "us", "er\nx"), (505, 0, "us\ner", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, _pos string")
    assert sorted((tuple(r) for r in chat.render(df).collect()), key=repr) == plain(rows)
    assert chat.render(df.limit(0)).count() == 0
