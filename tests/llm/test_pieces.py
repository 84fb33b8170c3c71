"""Merge segmentation against the reference library without dropout, against a plain agenda with it, and round trips."""

import random

import numpy as np
import pytest
import sentencepiece

from freshet.llm import pieces
from freshet.llm.queries import QUERIES, piece_model

MODEL = piece_model()


def codes_of(texts):
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def encoded(texts, rate, seed, keys=None):
    v = pieces.vocabulary(MODEL)
    keys = np.arange(len(texts), dtype=np.uint64) if keys is None else keys
    ids, at = pieces.encode_block(v, *codes_of(texts), keys, rate, seed)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def noise(seed, n=300):
    rng = random.Random(seed)
    parts = ["the ", "ing", "tion", "  ", "   ", " ", "é", "ß", "\n", "\t", "中文", "梦", "😀", "<s>", "▁", "Ⅻ", "a", "zq", "123", "http://x.y/z", "́", "ñ", "\x00", "–"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]
    return [*out, "", " ", "  ", "x" * 5000, "ab" * 900, "=" * 70, "longwordwithoutanyspaces" * 40]


def test_without_dropout_as_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t.replace("▁", "_").replace("\x00", "") for t in noise(1)]
    assert encoded(texts, 0.0, 1) == sp.encode(texts)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_round_trip_and_seeds(rate):
    texts = noise(2)
    v = pieces.vocabulary(MODEL)
    one, same, other = encoded(texts, rate, 5), encoded(texts, rate, 5), encoded(texts, rate, 6)
    assert one == same and (one != other) == (0 < rate < 1)
    for ids in (one, other):
        at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        data, ends = pieces.decode_block(v, np.array([i for x in ids for i in x], dtype=np.int64), at)
        assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts


def test_matrix_and_agenda_agree():
    v = pieces.vocabulary(MODEL)
    rng = random.Random(3)
    for _ in range(200):
        w = " " + "".join(rng.choices("theingonrs", k=rng.randint(1, 30)))
        sym = v.char_id[np.frombuffer(w.encode("utf-32-le"), np.uint32)]
        key = np.array([rng.getrandbits(63)], dtype=np.uint64)
        for rate in (0.0, 0.2, 0.7):
            got, size = pieces._merge_rows(v, sym[None, :].copy(), np.array([len(sym)]), key, rate)
            assert got[0, : size[0]].tolist() == pieces._merge_long(v, sym, key[0], rate).tolist()


def test_every_occurrence_is_drawn_by_itself():
    """Shared outcomes are those of merging each occurrence with its own key."""
    v = pieces.vocabulary(MODEL)
    words = ["the", "and", "nation", "reasonable", "information", "x", "internationalisation", "longwordwithoutanyspaces" * 2]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    seen = []
    draw = pieces.drawn
    try:
        pieces.drawn = lambda *a: seen.append(draw(*a)) or seen[-1]
        got = encoded(texts, 0.1, 3)
    finally:
        pieces.drawn = draw
    keys = iter(seen[0].tolist())
    for text, ids in zip(texts, got, strict=True):
        want = []
        codes = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
        kind = v.char_class[codes]
        for chunk in np.split(codes, np.flatnonzero(~v.beside[kind[:-1], kind[1:]]) + 1):
            want += pieces._merge_long(v, v.char_id[chunk], np.uint64(next(keys)), 0.1).tolist()
        assert ids == want
    assert len(set(seen[0].tolist())) == len(seen[0])


def test_share_and_variety_of_a_frequent_word():
    v = pieces.vocabulary(MODEL)
    docs, times = 200, 50
    for rate in (0.1, 0.3):
        for seed in (1, 2, 3):
            # One candidate merge a chunk: a space and a letter.
            for letter in "abst":
                assert v.lookup(v.char_id[[32]], v.char_id[[ord(letter)]])[0] >= 0
                got = encoded([" ".join([letter] * times)] * docs, rate, seed)
                split = sum(len(x) - times for x in got) / (docs * times)
                assert abs(split - rate) < 5 * (rate * (1 - rate) / (docs * times)) ** 0.5, (letter, seed, split)
    alone = encoded(["information"] * 5000, 0.1, 1)
    assert len({tuple(x) for x in alone}) > 30


def test_agenda_by_hand():
    """A plain agenda over pieces as strings: best score first, leftmost of equals, skipped by the keyed hash."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = pieces.vocabulary(MODEL)
    rng = random.Random(9)
    for _ in range(60):
        w = "".join(rng.choices("theandofinr", k=rng.randint(2, 14)))
        key, rate = np.uint64(rng.getrandbits(63)), 0.3
        parts, places = list(w), list(range(len(w)))
        while True:
            best = None
            for i in range(len(parts) - 1):
                p = sp.piece_to_id(parts[i] + parts[i + 1])
                if p == sp.unk_id():
                    continue
                a, b = sp.piece_to_id(parts[i]), sp.piece_to_id(parts[i + 1])
                if pieces.dropped(np.array([key]), np.array([places[i]]), np.array([a]), np.array([b]), rate)[0]:
                    continue
                if best is None or sp.get_score(p) > best[0]:
                    best = (sp.get_score(p), i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del places[i + 1]
        sym = v.char_id[np.frombuffer(w.encode("utf-32-le"), np.uint32)]
        assert pieces._merge_long(v, sym, key, rate).tolist() == [sp.piece_to_id(p) for p in parts]


def test_rows(spark):
    rows = [(1, "the thing", "p"), (1, "the thing", "q"), (None, "x", None), (2, None, "r"), (3, "", "s"), (4, "é\n" * 30_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    back = pieces.decode(pieces.encode(df, MODEL), MODEL)
    got = back.collect()
    assert len(got) == 6 and all(r["decoded"] == (r["text"] or "") for r in got)
    assert len({tuple(r["pieces"]) for r in got if r["doc_id"] == 1}) == 1
    assert pieces.decode(pieces.encode(df.limit(0), MODEL), MODEL).count() == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_pieces"](spark, sf)
    assert got.where("lossless").count() == spark.read.parquet(f"{sf}/documents.parquet").count() == got.count()
