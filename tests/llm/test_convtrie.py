"""The radix tree, and the trie against dictionaries of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from freshet.llm import art, convtrie


def test_tree_finds_every_aligned_prefix():
    rng = random.Random(5)
    for round_ in range(60):
        width = rng.choice([1, 2, 3])
        letters = bytes(range(rng.choice([2, 5, 20, 60, 256])))
        keys = {bytes(rng.choices(letters, k=width * rng.randint(0, 6))) for _ in range(rng.choice([0, 1, 5, 400]))}
        keys = sorted(keys, key=lambda k: rng.random())
        tree = art.Tree()
        for n, k in enumerate(keys):
            tree.insert(k, n)
        nodes = list(tree.aligned(width))
        prefixes = {}
        for d, up, some, key in nodes:
            p = keys[some][: d * width]
            assert p not in prefixes
            prefixes[p] = key
            assert up == -1 if d == 0 else (nodes[up][0] == d - 1 and keys[nodes[up][2]][: (d - 1) * width] == p[: (d - 1) * width])
        assert set(prefixes) == {k[: d * width] for k in keys for d in range(len(k) // width + 1)}
        assert {p: keys.index(p) for p in prefixes if p in keys} == {p: k for p, k in prefixes.items() if k is not None}
    assert round_ == 59


def test_layouts_grow():
    tree = art.Tree()
    seen = []
    for n, b in enumerate(random.Random(1).sample(range(256), 256)):
        tree.insert(bytes([7, b]), n)
        seen.append(tree.root.layout())
    assert [seen.index(x) for x in (4, 16, 48, 256)] == [0, 4, 16, 48]
    assert tree.root.path == b"\x07" and [b for b, _ in tree.root.items()] == list(range(256))


def plain(rows):
    """Nodes of the trie by prefixes as tuples; ``rows`` holds (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, own, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:])  # the remainder of SQL
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if seqs[c] == p)
        children = sum(len(q) == len(p) + 1 for q in below)
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), -1 if up is None else up, len(cs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, size):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq string").repartition(5)
    nodes = convtrie.trie(convtrie.with_shared_heads(convtrie.conversations(df)), range_bytes=size).collect()
    assert len({(r["conv_id"], r["depth"]) for r in nodes}) == len(nodes)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in nodes)


@pytest.mark.parametrize("size", [1 << 20, 1500, 400])
def test_trie_of_many_ranges(spark, size):
    rng = random.Random(size)
    rows = []
    for c in range(60):
        # A third of all conversations is the same, and most have the same start.
        n = 3 if c % 3 == 0 else rng.randint(0, 11)
        for t in range(n):
            word = "hello" if t == 0 or c % 3 == 0 else rng.choice(["a", "b", "é" * t, None])
            rows.append((c, rng.choice([t, t, None]) if c % 7 == 0 else t, rng.choice(["user", "user", None]) if c % 3 else "user", word))
    rows += [(70, t, "user", f"line {t % 3}") for t in range(45)] + [(71, t, "user", f"line {t % 3}") for t in range(44)]
    rows += [rows[0]] * 2 + [(None, 1, "user", "no conversation"), (-3, 0, "user", "below zero"), (10**12, 0, None, None), (5, 0, "user", "long " * 5000)]
    assert got(spark, rows, size) == plain(rows)


def test_turnless_and_empty(spark):
    # Conversation 1 takes all its turns from conversation 0, which does not exist.
    h = zlib.crc32(b"1") % 9
    rows = [(1, t, "user", str(t)) for t in range(h)]
    want = [(1, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert h > 0 and got(spark, rows, 1 << 20) == want == plain(rows)
    assert got(spark, rows[:0], 1 << 20) == []


def test_ids_of_a_key_are_joined_in_order(spark):
    ids = [3, 5, 9, 100_000, 100_001, 4_000_000_000, *range(200, 30_000)]
    df = spark.createDataFrame([("k", i) for i in ids] + [("one", 7)], "kid string, conv_id long").repartition(6)
    found = {r["kid"]: r["ends_sha256"] for r in convtrie._ends(df).collect()}
    assert found == {"k": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), "one": hashlib.sha256(b"7").hexdigest()}
