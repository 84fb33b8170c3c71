"""Sentence spans against a plain version of the same definition."""

import random
import re

from freshet.llm import passages
from freshet.llm.queries import QUERIES


def split(text):
    """(pieces with their white space, words of each)."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    begin = []
    for i, m in enumerate(found):
        before = text[found[i - 1].end() : m.start()] if i else ""
        if i == 0 or found[i - 1][0][-1] in ".!?:;" or "\n" in before or re.match(r"[A-ZÀ-ÖØ-Þ]", m[0]):
            begin.append(i)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = []
    for a, b in zip(begin, [*begin[1:], len(found)][: len(begin)], strict=True):
        cut.append(a)
        if b - a > passages.LONG_SENTENCE:
            cut += [i for i in range(a + 1, b) if sum(found[i][0].translate(low).encode()) % passages.CUT_EVERY == 7]
    begin = cut
    edges = [0, *(found[i].start() for i in begin[1:]), len(text)] if begin else []
    pieces = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pieces, [re.findall(r"[^\x20\x09-\x0D]+", p.translate(low)) for p in pieces]


def plain(rows, least=(3, 12)):
    def many(ws):
        return len(ws) >= least[0] and sum(map(len, ws)) >= least[1]

    def alone(ws):
        return len(ws) >= 1 and sum(map(len, ws)) >= passages.ALONE_WORDS

    seen, per = {}, {}
    for i, t in sorted(rows):
        pieces, ws = split(t or "")
        n = len(ws)
        found = set()
        for s in range(n):
            for good in (many, alone):
                e = next((e for e in range(s + 1, n + 1) if good(ws[s:e])), None)
                if e and (good is many or e - s < least[0]):
                    found.add((s, e))
                b = next((b for b in range(s, -1, -1) if good(ws[b : s + 1])), None)
                if b is not None and (good is many or s + 1 - b < least[0]):
                    found.add((b, s + 1))
        per[i] = (pieces, found, ws)
        for s, e in sorted(found):
            seen.setdefault(tuple(w for x in ws[s:e] for w in x), []).append((i, s, e))
    gone = {i: set() for i in per}
    for spots in seen.values():
        for i, s, e in sorted(spots)[1:]:
            gone[i].update(range(s, e))
    return sorted((i, len(p), len(gone[i]), "".join(x for k, x in enumerate(p) if k not in gone[i]) if gone[i] else (rows_text or "")) for i, (p, _, _) in per.items() for rows_text in [dict(rows)[i]])


def test_noise(spark):
    rng = random.Random(2)
    parts = ["one two three four. ", "five six; ", "Seven eight nine ten eleven!\n", "é à ", "Été froid ", "a b c d e f g. ", "x ", "\n\n", "Z? "]
    passage = "Red green blue stones lie here. They were found in a field. Nobody knows who put them there, or why. It is so. "
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14))) + (passage if i % 5 == 0 else "") + "".join(rng.choices(parts, k=4))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "In. " * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int")
    got = sorted(tuple(r) for r in passages.without_repeats(df).collect())
    assert got == plain(rows)
    assert passages.without_repeats(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    t = "A long enough first sentence stands here. And then another one follows it. A third one ends the text. "
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (8, t)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"], r["text"]) for r in passages.without_repeats(df).collect()), key=repr)
    assert got == sorted([(7, 0, t), (7, 0, t), (8, 3, ""), (None, 0, t)], key=repr)


def test_short_and_endless_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    one = " ".join(word() for _ in range(45)).capitalize() + "."
    two = " ".join(word() for _ in range(25)).capitalize() + ". " + " ".join(word() for _ in range(22)).capitalize() + "."
    endless = " ".join(word() for _ in range(400))
    own = lambda: " ".join(word() for _ in range(9)).capitalize() + ". "
    rows = [(i, own() + t + " " + own()) for i, t in enumerate([one, two, one, two])]
    rows += [(10, " ".join(word() for _ in range(200)) + " " + endless), (11, " ".join(word() for _ in range(300)) + " " + endless + " " + " ".join(word() for _ in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in passages.without_repeats(df).collect()}
    assert sorted((i, t) for i, t in got.items()) == sorted((i, t) for i, _, _, t in plain(rows))
    assert one in got[0] and two in got[1] and one not in got[2] and two not in got[3] and got[10] == rows[4][1]
    assert len(got[11].split()) < 300 + 90 + 120


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op3_passages"](spark, sf).collect()) == plain(rows)
