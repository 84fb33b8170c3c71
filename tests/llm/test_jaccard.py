"""The Jaccard join against plain sets."""

import random
import re
from collections import Counter, defaultdict

import pytest

from freshet.llm import jaccard
from freshet.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size=4, t=(85, 100)):
    """(doc_id, n, component) by counting shared shingles of every pair."""
    sets = [(i, sets_of(x, size)) for i, x in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                holders[g].append(k)
    shared = Counter()
    for ks in holders.values():
        for x in range(len(ks)):
            for y in range(x):
                shared[ks[y], ks[x]] += 1
    for (a, b), n in shared.items():
        if t[1] * n >= t[0] * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = top(sets[a][0]), top(sets[b][0])
            up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, x, "k") for i, x in rows], "doc_id long, text string, component string")
    return sorted((tuple(r) for r in jaccard.classes(df, **kw).collect()), key=repr)


def varied(seed, n, words):
    """Texts with chains of small edits, so that pairs stand on both sides of the threshold."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
            w = w + rng.choices(words, k=rng.randint(0, len(w) // 12))
        else:
            w = rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 9, 30, 70, 150, 300]))
        out.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w)))
    return out


def test_edge_cases(spark):
    rows = [
        (5, None), (6, ""), (7, " \n\t"), (1, "A b c"), (2, "a B\tc"), (3, "a b c d"), (4, "A\nb c d"), (None, "a b c d"), (None, None),
        (9, "x " * 30_000), (8, "x x x x x"), (10, "É b c d e"), (11, "é b c d e"), (3, "other words in a row of one id"), (12, "other words in a row of one id"),
        (12, "other words in a row of one id"),
    ]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_varied_edits(spark, seed):
    words = [f"w{i}" for i in range(40)]
    rows = varied(seed, 160, words)
    want = brute(rows)
    assert len({c for _, _, c in want}) < 150
    assert got(spark, rows) == want


def test_prefixes_meet_at_every_size():
    for n in range(1, 400):
        least = -(-85 * n // 100)
        assert jaccard.prefix_length(n) == n - least + 1 >= 1
        assert jaccard._short(n, (85, 100)) <= jaccard.prefix_length(n)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_jaccard"](spark, sf).collect()), key=repr) == brute(rows)


def test_crowded_tiles_emit_no_unlike_pairs(spark):
    """Long texts that share one rare passage passed their short bitmaps, all pairs of them (pipeline)."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(450)) + " " + passage) for i in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    t = (80, 100)
    signs = jaccard.signatures(texts, 5, t, jaccard.rarity(texts, 5)).cache()
    key = jaccard.F.lit(1).cast("long")
    member = signs.select(key.alias("key"), jaccard.F.lit(8).cast("long").alias("band"), "doc_id", jaccard.F.lit(0).alias("pos"), jaccard.F.lit(True).alias("home"), jaccard.F.col("doc_id").alias("component"))
    assert jaccard._tile_pairs(member, signs, t).count() == 0
    near = [(100, rows[0][1] + " one"), (101, rows[1][1] + " two more words")]
    assert got(spark, rows + near, size=5, threshold=t) == brute(rows + near, 5, t)
