"""The automaton against plain edit distances, quotation against abuse, and held-out accuracy."""

import functools
import random
import zlib

from freshet.llm import toxicity as tox
from freshet.llm.queries import QUERIES


def distance(a, b, swaps=1):
    """Edits between two words, swaps of neighbours among them at most so often; plain recursion over the ends."""

    @functools.lru_cache(maxsize=None)
    def d(i, j, left):
        if not i or not j:
            return i + j
        out = min(d(i - 1, j, left) + 1, d(i, j - 1, left) + 1, d(i - 1, j - 1, left) + (a[i - 1] != b[j - 1]))
        if left and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            out = min(out, d(i - 2, j - 2, left - 1) + 1)
        return out

    return d(len(a), len(b), swaps)


def garbled(rng, word, letters, times):
    w = list(word)
    for _ in range(times):
        k = rng.randrange(len(w) + 1)
        if rng.random() < 0.3 and k + 1 < len(w):
            w[k], w[k + 1] = w[k + 1], w[k]
        else:
            w[k : k + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
    return "".join(w)


def reach(word, entries, stems):
    """(distance, -weight, name) of all fuzzy entries in reach, by plain distances."""
    found = [(max(1, distance(word, e)), -o, e) for e, o in entries.items() if len(e) >= 5 and distance(word, e) <= tox.edits(len(e))]
    for e, o in stems.items():
        if len(e) >= 5:
            near = min(distance(word[:k], e) for k in range(len(e) - 1, min(len(e) + 1, len(word)) + 1)) if len(word) >= len(e) - 1 else 9
            found += [(max(1, near), -o, e + "*")] if near <= 1 else []
    return found


def test_trie_and_automaton_find_what_plain_distances_find():
    rng = random.Random(1)
    entries = {"".join(rng.choices("abcdé", k=rng.randint(3, 11))): rng.random() + 0.1 for _ in range(60)}
    stems = {"zaba": 2.0, "zabab": 3.0, "dczbaz": 1.5}
    lexicon = tox.Lexicon(entries, stems, {*entries, *(s + "*" for s in stems)})
    hits = 0
    for _ in range(4000):
        w = garbled(rng, rng.choice([*entries, "zababc", "dczbazaa", "xyz"]), "abcdéz", rng.randint(0, 3))
        if not w or any(len(set(w[k : k + 3])) == 1 for k in range(len(w) - 2)):
            continue
        got = lexicon.match(w)
        own = [(-o, s) for s, o in stems.items() if w.startswith(s)]
        if w in entries:
            assert got == (w, entries[w], 0)
        elif own:
            assert got == (min(own)[1] + "*", -min(own)[0], 0)
        else:
            near = min(reach(w, entries, stems), default=None)
            assert got == (near and (near[2], -near[1], near[0])), w
            hits += near is not None
            # The letters alone never rule out what is in reach.
            maybe = lexicon.maybe_near_words(["x", w, "yyy"])[1]
            assert maybe or near is None, w
            assert lexicon.near(w, maybe) == got, w
    assert hits > 500


def test_obfuscations():
    lexicon = tox.Lexicon({"idiot": 6.0, "worthless": 6.0, "disgusting": 6.0}, {})
    for text, entry in (
        ("idiot", "idiot"), ("idoit", "idiot"), ("idiooot", "idiot"), ("iidiot", "idiot"), ("1d1ot", "idiot"), ("i d i o t", "idiot"), ("I.D.I.O.T", "idiot"),
        ("i-d-i-o-t!", "idiot"), ("id*ot", "idiot"), ("id**t", None), ("wrthles", "worthless"), ("wortlhes", "worthless"), ("dizguzting", "disgusting"), ("disssgusting", "disgusting"),
        ("idiom", "idiot"), ("idle", None), ("worth", None), ("a b c d e f", None), ("i d i o t i c a l", "idiot"), ("u r a n i d i o t", "idiot"),
    ):
        got = tox.matches(f"you {text} there", lexicon)
        assert [m.entry for m in got] == ([entry] if entry else []), text
        assert lexicon.filter.texts(tox.pa.array([f"x {text}"]), lexicon)[0] or not got, text
        if got:
            assert (got[0].distance > 0) == (text != "idiot")


def test_filter_misses_no_match():
    rng = random.Random(4)
    lexicon = tox.Lexicon({"moron": 5.0, "éclair": 3.0, "bad": 2.0, "worthless": 4.0, "ñandú": 1.0}, {"lowei": 4.0, "étéd": 2.0})
    parts = ["moron", "Mor0n", "worthles", "WORTHLESSS", "étédu", "ÉTÉDa", "bad", "b@d", "loweix", "éclairs", "ñandù", "the", "“", "«", "_", "$", "@", " ", "\n", "…", "、", "a1", "...", "x"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(3000)] + ["", None]
    got = lexicon.filter.texts(tox.pa.array(texts), lexicon)
    for t, g in zip(texts, got.tolist(), strict=True):
        assert g or not tox.matches(t or "", lexicon), t
    assert 100 < sum(got) < 2900


def test_signs_and_context():
    lexicon = tox.Lexicon({"moron": 5.0, "stupid": 5.0}, {"vequ": 4.0})
    found = [(m.entry, m.distance, m.quoted) for m in tox.matches('You mor0n, you stuppid one. "A moron," he said. vequxyz İstupid', lexicon)]
    assert found == [("moron", 1, False), ("stupid", 1, False), ("moron", 0, True), ("vequ*", 0, True), ("stupid", 1, True)]
    assert tox.features("You moron", lexicon)[5] == 0 < tox.features("You moron", lexicon)[1]
    assert tox.features('"moron"', lexicon)[1] == 0 < tox.features('"moron"', lexicon)[5]
    assert tox.features("morron", lexicon)[1] == 0 < tox.features("morron", lexicon)[3]
    assert tox.matches("", lexicon) == [] and tox.features("nothing here", lexicon) == [1.0] + [0.0] * 5
    # One mark without its pair hides nothing, and a pair over two lines neither.
    for text in ('5" of a moron and more', 'he "is a moron and', '"one\nmoron"', "« moron » moron"):
        assert not tox.matches(text, lexicon)[-1].quoted, text


def test_bytes_and_whole_texts_give_the_same_features():
    rng = random.Random(9)
    words = {"moron": 5.0, "stupid": 5.5, "worthless": 4.5, "éclair": 3.0, "bad": 2.0}
    parts = ["moron", "mroon", "St0pid", "stupiiid", "worthles", "s t u p i d", "vequé", "fine", "words", "éclair", "bad", "“moron”", '"', "said", "\n", "m*ron", "€", "…", "中文", "a"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)] + [None, "", "stupid " * 3000]
    got = tox.all_features(tox.pa.array(texts), tox.Lexicon(words, {"vequ": 4.0}))
    for t, g in zip(texts, got.tolist(), strict=True):
        assert g == tox.features(t or "", tox.Lexicon(words, {"vequ": 4.0})), t


def test_longer_text_hides_nothing():
    lexicon = tox.Lexicon({"moron": 5.0, "stupid": 5.0}, {})
    short = tox.features("you stupid moron", lexicon)
    assert tox.features("fine words " * 20_000 + "you stupid moron" + " more words" * 20_000, lexicon) == short


def test_filter_cuts_words_as_the_pattern():
    lexicon = tox.Lexicon({"moron": 5.0}, {})
    parts = ["moron", "morn", "*", "**", "é", "中", "😀", "→", "™", "！", "،", "٣", "Ⅻ", "́", "_", "@", "$", "·", "x", " ", "×", "\x00"]
    rng = random.Random(6)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(3000)]
    got = tox.Lexicon({"moron": 5.0}, {}).filter.texts(tox.pa.array(texts), lexicon)
    assert got.tolist() == [bool(tox.matches(t, lexicon)) for t in texts]
    raw = "".join(texts).encode()
    low = tox._lowered(tox.np.frombuffer(raw, tox.np.uint8))
    at = tox.np.concatenate(([0], tox.np.cumsum([len(t.encode()) for t in texts])))
    cut = [low[a:b].tobytes().decode() for a, b in zip(*tox._tokens(low, at), strict=True)]
    assert cut == [w for t in texts for w in tox._WORD.findall(t.translate(tox._CAPITALS))]


def test_rare_words_and_families_match_misspelled(spark):
    """A corpus of many insults, none in as much as 5% of the toxic rows, and one family of a stem."""
    rng = random.Random(2)
    insults = ["".join(rng.choices("bdfgklmnprst", k=1)) + "".join(rng.choices("aeioubdfgklmnprst", k=7)) for _ in range(40)]
    family = ["zyxwvo" + "".join(rng.choices("aeiou", k=3)) for _ in range(12)]
    rows = []
    for i in range(800):
        rows.append((2 * i, f"you {insults[i % 40]} {insults[(i * 7 + 3) % 40]} {family[i % 12]} go", 1))
        rows.append((2 * i + 1, "the " + " ".join("".join(rng.choices("hjqv", k=6)) for _ in range(4)), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    lexicon = model.lexicon()
    assert sum(w in model.words for w in insults) >= 30 and model.stems
    entries = [w for w in [*insults, *family] if lexicon.exact(w)]
    assert len(entries) >= 40
    for w in entries:
        for k in range(1, len(w)):
            for wrong in (w[:k] + "h" + w[k:], w[:k] + "h" + w[k + 1 :], w[:k] + w[k + 1 :]):
                assert lexicon.match(wrong) is not None, wrong
        assert tox.all_features(tox.pa.array([f"oh {w[:3]}h{w[4:]}"]), lexicon)[0, 3] > 0


def test_rows_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", 9.0), (None, None, 1.0), (1, "", 2.0), (4, "w " * 40_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = tox.scored(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, None, 4)}
    assert tox.scored(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op8_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    # Some labels of this small table stand on texts without any sign of it.
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


INSULTS = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()


def wrong(rng, w, kind):
    k = rng.randrange(1, len(w) - 1)
    return {
        "exact": w,
        "one letter": w[:k] + rng.choice("aeinorst") + w[k + 1 :],
        "left out": w[:k] + w[k + 1 :],
        "swapped": w[:k] + w[k + 1] + w[k] + w[k + 2 :],
        "tripled": w[:k] + w[k] * 3 + w[k + 1 :],
        "apart": " ".join(w),
        "dots": ".".join(w),
        "star": w[:k] + "*" + w[k + 1 :],
    }[kind]


def test_insults_put_into_clean_texts(spark):
    """Of clean texts with n insults put in, nearly all are found, however they are written; the clean texts stay clean."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = tox.learn(docs, labels)
    lexicon, w = model.lexicon(), tox.np.array(model.weights)
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(tox.held_out(tox.F.col("doc_id"))).orderBy("doc_id").limit(300)
    texts = [r["text"] for r in clean.select("text").collect()]
    rng = random.Random(7)

    def share(texts):
        return float((tox._logistic(tox.all_features(tox.pa.array(texts), lexicon) @ w) >= 0.7).mean())

    assert share(texts) <= 0.01
    long_ones = [x for x in INSULTS if len(x) >= 5]
    for kind in ("exact", "one letter", "left out", "swapped", "tripled", "apart", "dots", "star"):
        for n in (3, 5):
            made = []
            for t in texts:
                words = t.split(" ")
                for x in rng.sample(long_ones, n):
                    words.insert(rng.randrange(len(words) + 1), wrong(rng, x, kind))
                made.append(" ".join(words))
            assert share(made) >= 0.95, (kind, n, share(made))
