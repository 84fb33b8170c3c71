"""Winnowing against a plain version, with the guarantee that a long shared run is found."""

import hashlib
import random

import regex

from freshet.llm import winnow
from freshet.llm.queries import QUERIES


def tokens(text):
    return regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]|[\p{L}\p{M}\p{N}_]{1,16}", text or "")


def grams(spark, texts, k=3):
    """xxhash64 of token runs as the operator defines them, from Spark's own function on single rows."""
    from pyspark.sql import functions as F

    words = sorted({w for t in texts for w in tokens(t)})
    one = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words] or [("",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    level = {t: [one[w] for w in tokens(t)] for t in texts}
    pairs = sorted({(a, b) for v in level.values() for a, b in zip(v, v[1:], strict=False)})

    def hashed(pairs):
        df = spark.createDataFrame(pairs or [(0, 0)], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"))
        return {(r["a"], r["b"]): r["h"] for r in df.collect()}

    two = hashed(pairs)
    second = {t: [two[a, b] for a, b in zip(v, v[1:], strict=False)] for t, v in level.items()}
    three = hashed(sorted({(a, b) for v in second.values() for a, b in zip(v, v[1:], strict=False)}))
    return {t: [three[a, b] & (1 << 36) - 1 for a, b in zip(v, v[1:], strict=False)] for t, v in second.items()}, level


def plain(h, w=4):
    """Minimum of each window, rightmost of equals, each place once."""
    out = []
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        if part:
            low = min(part)
            at = i + max(k for k, x in enumerate(part) if x == low)
            if not out or out[-1] != (at, low):
                out.append((at, low))
    return out


def packed(row):
    return [((1 << 27) - 1 - (x & (1 << 27) - 1), x >> 27) for x in row]


def test_fingerprints(spark):
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "dd", "é", "aa"]
    texts = [" ".join(rng.choices(words, k=n)) for n in [3, 4, 5, 6, 7, 8, 20, 60, 200]] + ["aa " * 40, "漢字かな交じり文", "x" * 50]
    want, _ = grams(spark, texts)
    got = winnow.fingerprints(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "fp").collect()
    for r in got:
        assert packed(r["fp"]) == plain(want[r["text"]]), r["text"]


def test_shared_runs_are_found(spark):
    rng = random.Random(5)
    for _ in range(3):
        shared = [f"s{i}" for i in range(6)]  # w + k - 1 tokens
        a, b = ([f"{c}{rng.randint(0, 99)}" for _ in range(30)] for c in "xy")
        rows = [(" ".join(v[:9] + shared + v[9:]),) for v in (a, b)]
        one, two = (set(x[1] for x in packed(r["fp"])) for r in winnow.fingerprints(spark.createDataFrame(rows, "text string"), "text", "fp").collect())
        assert one & two


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + after[:half], after))
    return out


def check(spark, df, rows):
    got = winnow.compare_neighbours(df).collect()
    want = brute_edits(rows)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in got), key=repr) == sorted((w[:3] for w in want), key=repr)
    prints = {}
    for r in winnow.fingerprints(spark.createDataFrame([(t,) for t in {x for w in want for x in (w[2], w[3])}], "text string"), "text", "fp").collect():
        prints[r["text"]] = {x >> 27 for x in r["fp"]}

    def like(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        mine = {x >> 27 for x in r["fp"]}
        assert r["near_edited"] == like(mine, prints[r["edited"]])
        if sum(i == r["doc_id"] for i, _ in rows) == 1:
            after = next(w[3] for w in want if w[0] == r["doc_id"])
            assert r["near_next"] == like(mine, prints[after])


def test_neighbours_with_edge_cases(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i * 7 % 1009, " ".join(rng.choices(["ab", "cd", "ef", "é"], k=rng.randint(0, 30)))) for i in range(300)]
    rows += [(None, "no id here at all"), (None, None), (5000, None), (5001, ""), (5002, "same"), (5002, "same"), (5003, "日本 " * 500)]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, own int, bucket string")
    check(spark, df, rows)
    monkeypatch.setattr(winnow, "ROWS_PER_BUCKET", 40)
    check(spark, df, rows)
    check(spark, df.where("doc_id IS NOT NULL"), [r for r in rows if r[0] is not None])


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(4, "alone in the table")], "doc_id long, text string")
    r = winnow.compare_neighbours(df).first()
    assert r["edited"] == "alone in " + "alone in " and r["near_next"] == 1.0
    assert winnow.compare_neighbours(df.limit(0)).count() == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _ in brute_edits(rows)}
    got = QUERIES["op4_winnow"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)
