"""Base rules against plain regular expressions, the dynamic programme against all choices, and what the field adds."""

import hashlib
import itertools
import random
import re

from freshet.llm import pii
from freshet.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_sum(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    def digits(m):
        return re.sub(r"[^0-9]", "", m[0])

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and check_sum(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_rules_on_noise():
    rng = random.Random(4)
    parts = list("ab.@-+_% ()12079é") + ["@x.y", "1.2.3.4", "4111 1111 1111 1111", "+1 (217) 555-7713", "a@b.c.@d.e", "999.1.1.1", "0001.2.3.4", "١٢٣"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_stay_linear():
    for t in ("9" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000, "@" * 100_000):
        assert pii.base_spans(t) == plain(t) if len(t) < 1000 else isinstance(pii.spans_of(t, {}), tuple)


def test_best_is_best():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 7)
        segs = [(a, a + rng.randint(1, 6), "k") for a in (rng.randint(0, 12) for _ in range(n))]
        scores = [rng.randint(-3, 5) for _ in range(n)]

        def free(pick):
            s = sorted(segs[i] for i in pick)
            return all(x[1] <= y[0] for x, y in itertools.pairwise(s))

        most = max(sum(scores[i] for i in p) for k in range(n + 1) for p in itertools.combinations(range(n), k) if free(p))
        got = pii.best(segs, scores)
        assert free(got) and sum(scores[i] for i in got) == most


def test_rows_and_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "me@example.com"), (2, "me@example.com"), (2, "me@example.com"), (3, "é" * 5 + " 10.0.0.1 " + "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"], r["base"], r["redacted"]) for r in pii.find(df).collect()), key=repr)
    assert len(got) == 6 and [g for g in got if g[0] == 3] == [(3, "ip:6:14", "é" * 5 + " [IP] " + "x " * 50_000)]
    assert [g[1] for g in got if g[0] is None] == ["email:0:14"] and sum(g[1:] == ("email:0:14", "[EMAIL]") for g in got) == 3
    assert pii.find(df.limit(0)).count() == 0


def test_documents_and_added_secrets(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    added = 0
    for r in QUERIES["op1_pii"](spark, sf).collect():
        base = plain(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in base) for k in pii.BASE_KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(spans) >= set(said.split(",") if said else [])
        added += sum(s.startswith("secret") for s in spans)
    secrets = sum(len(re.findall(r'token = "[0-9a-fA-F]{40}"', t, re.IGNORECASE)) for t in texts.values())
    assert secrets and added >= 0.9 * secrets
