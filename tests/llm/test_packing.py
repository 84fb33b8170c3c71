"""Packing: exact pieces of the library's own ids, full sequences, balanced costs."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from freshet.llm import packing
from freshet.llm.queries import QUERIES, pack_vocabulary

SF = "/root/testdata/sf0.001"


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pack_vocabulary())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def plain_assign(sizes, length, width):
    """The rule read aloud: the largest document first, the cheapest sequence that has room, else a cut."""
    rooms = packing.rooms_for(sum(sizes), length)
    seqs = [{"room": r, "cost": 0, "used": 0} for r in rooms]
    todo = sorted((length, d, s) for d, n in enumerate(sizes) for s in range(0, n - length + 1, length))
    todo += sorted((n % length, d, n - n % length) for d, n in enumerate(sizes) if n % length)
    todo.sort(key=lambda x: (-x[0], x[1], x[2]))
    out = []
    while todo:
        n, d, s = todo.pop(0)
        fits = [k for k, q in enumerate(seqs) if q["room"] >= n]
        if fits:
            k, part = min(fits, key=lambda k: (seqs[k]["cost"], k)), n
        else:
            part = max(q["room"] for q in seqs)
            k = min((k for k, q in enumerate(seqs) if q["room"] == part), key=lambda k: (seqs[k]["cost"], k))
            todo.append((n - part, d, s + part))
            todo.sort(key=lambda x: (-x[0], x[1], x[2]))
        q = seqs[k]
        out.append((d, s, part, k, q["used"]))
        q["room"] -= part
        q["used"] += part
        q["cost"] += packing.cost_of(part, width)
    return out


def test_rule_against_the_plain_version():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([8, 16, 64])
        sizes = [rng.choice([1, 2, 5, rng.randint(1, 3 * length)]) for _ in range(rng.randint(0, 40))]
        assert sorted(packing.assign(sizes, length, 4)) == sorted(plain_assign(sizes, length, 4)), sizes


def test_encoder_is_the_library():
    rng = random.Random(1)
    odd = ["", " ", "a<|endoftext|>b", "  two\n\n\tx ", "it's I'LL 'twas", "naïve ÉTÉ straße", "漢字かな交じり", "🙂👍🏽é", "\u0000­﻿ ", "x" * 5000, " " * 3000, "1234567 ½ Ⅻ ٣"]
    odd += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(200)]
    enc = packing.encoder(pack_vocabulary())
    assert enc.fast is not None
    for text, want in zip(odd, library_ids(odd), strict=True):
        assert enc(text).tolist() == want, text[:40]
    enc = packing.Encoder(pack_vocabulary())
    enc.fast = None
    assert enc("it's <|endoftext|> ok").tolist() == library_ids(["it's <|endoftext|> ok"])[0]


def test_other_vocabularies_use_the_library():
    import public_tokenizers

    enc = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.fast is None and len(enc("Some words")) == 2


def check_pieces(rows, docs, length):
    """``docs`` holds (doc_id, text) of every row; ``rows`` the pieces."""
    want = sorted(((i is not None, i or 0), ids + [packing.END_ID]) for (i, _), ids in zip(docs, library_ids([t or "" for _, t in docs]), strict=True))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    got = []
    for i, pieces in by_doc.items():
        # Repeated ids: pieces that go on from one another make a document.
        pieces.sort(key=lambda r: (r["doc_tokens"], r["start"], r["sequence_id"], r["offset"]))
        ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in pieces]
        assert all(len(x) == r["length"] for x, r in zip(ids, pieces, strict=True))
        if sum(r["start"] == 0 for r in pieces) == 1:
            at = 0
            for r in pieces:
                assert r["start"] == at
                at += r["length"]
            assert at == pieces[0]["doc_tokens"]
            got.append(((i is not None, i or 0), sum(ids, [])))
        else:
            # The same tokens in all, cut as they may be.
            own = [w[1] for w in want if w[0] == (i is not None, i or 0)]
            assert sorted(sum(ids, [])) == sorted(sum(own, []))
            got.extend(w for w in want if w[0] == (i is not None, i or 0))
    assert sorted(got) == want
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or (at < length and at & (at - 1) == 0)
    return by_seq


def test_query_over_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), pack_vocabulary()).collect()
    by_seq = check_pieces(rows, docs, packing.LENGTH)
    asked = QUERIES["op12_pack"](spark, SF).collect()
    key = lambda r: (r["doc_id"], r["start"])
    for a, r in zip(sorted(asked, key=key), sorted(rows, key=key), strict=True):
        assert a["ids_crc32"] == zlib.crc32(r["ids"]) and (a["sequence_id"], a["offset"]) == (r["sequence_id"], r["offset"])
    # Sequences without a piece of full length differ little in cost.
    costs = [sum(r["cost"] for r in s) for s in by_seq.values() if sum(r["length"] for r in s) == packing.LENGTH and len(s) > 1]
    assert max(costs) <= 1.2 * min(costs)
    table = {r["sequence_id"]: r for r in packing.sequences(spark.createDataFrame(rows)).collect()}
    for i, s in by_seq.items():
        own = sorted(s, key=lambda r: r["offset"])
        n = sum(r["length"] for r in s)
        assert (table[i]["n_tokens"], table[i]["padded_to"], table[i]["cost"]) == (n, n, sum(r["cost"] for r in s))
        assert bytes(table[i]["ids"]) == b"".join(bytes(r["ids"]) for r in own)


def test_edges(spark):
    docs = [(1, "a"), (1, "a"), (1, "other text"), (None, "null id"), (None, None), (2, None), (3, ""), (4, "long words " * 9000)] + [(7, "same row again")] * 300
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, sequence_id int, ids string")
    for size in (600, 1 << 20):
        rows = packing.pack(df, pack_vocabulary(), length=64, group_bytes=size).collect()
        check_pieces(rows, docs, 64)
        # The same rows dealt out otherwise give the same pieces.
        again = packing.pack(df.repartition(7, "text"), pack_vocabulary(), length=64, group_bytes=size).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert packing.pack(df.limit(0), pack_vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, pack_vocabulary(), length=100)
