"""The pipeline against its stages applied to plain rows."""

from collections import Counter

import corpus_pipeline
from freshet.llm import jaccard, mix, pieces, pii, toxicity
from freshet.llm.queries import piece_model
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.01"  # fewer labelled rows hold no significant word


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.learn(docs, labels)
    lexicon = model.lexicon()

    def score(t):
        z = sum(a * b for a, b in zip(toxicity.features(t, lexicon), model.weights, strict=True))
        return 1 / (1 + 2.718281828459045 ** -z)

    kept = {i: r for i, r in rows.items() if score(r["text"]) < 0.7}
    assert 0 < len(kept) < len(rows)
    one = corpus_pipeline.clean(spark, docs, SF)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == set(kept)

    first = {i for i, _, c in brute([(i, r["text"]) for i, r in kept.items()], 5, (80, 100)) if i == c}
    two = corpus_pipeline.distinct_texts(spark, one, SF)
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == first and len(first) < len(kept)

    weights = pii.fit(two)
    three = corpus_pipeline.private(spark, two, SF)
    got = {r["doc_id"]: r for r in three.collect()}
    for i in first:
        want = pii.redacted(rows[i]["text"], pii.spans_of(rows[i]["text"], weights)[1])
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))
    assert any("[EMAIL]" in r["text"] for r in got.values())

    four = corpus_pipeline.mixed(spark, three, SF)
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in mix.interleave(three, mix.tempered(three)).collect()}
    order = [r["doc_id"] for r in four.collect()]
    assert four.columns == docs.columns and order == sorted(order, key=slots.get) and set(order) == first

    five = {r["doc_id"]: r["pieces"] for r in corpus_pipeline.segmented(spark, four, SF).collect()}
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(corpus_pipeline.segmented(spark, four, SF), piece_model()).collect()}
    assert back == {i: r["text"] for i, r in got.items()}

    whole = {r["doc_id"]: r["pieces"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == five
    assert jaccard.band_of(1) == 0


def test_result_has_the_mix(spark):
    rows = [(r["doc_id"], r["source"], r["mix_slot"], r["mix_place"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert [x[2:] for x in rows] == sorted(x[2:] for x in rows)
    count = Counter(x[1] for x in rows)
    weight = {s: n**0.5 / sum(m**0.5 for m in count.values()) for s, n in count.items()}
    # A slot has one block of one source; while no source is used up, each has its share of the slots within a block.
    owner = {}
    for _, source, slot, _ in rows:
        assert owner.setdefault(slot, source) == source
    # The first block of each source is due before slot 1 / weight.
    for s in count:
        assert min(t for t, o in owner.items() if o == s) <= 1 / weight[s]


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, a very long text and columns with the names that the stages make."""
    long_text = "Many words make a long text, line after line, with no end in sight.\n" * 4000
    base = [(1, "one two three four five six seven", "en", "a", 33, 5, "p"), (2, None, None, None, None, 6, None), (None, "without an id, mail me@example.org", "en", "a", 1, 7, "q"), (None, None, "en", None, 0, None, "r")]
    rows = [*base, base[0], base[0], base[2], (3, "", "de", "b", 0, 8, "s"), (4, long_text, "en", "a", len(long_text), 9, "t"), (5, long_text, "en", "b", len(long_text), 9, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix_slot int, pieces string")
    names = docs.columns

    def ids(df):
        return sorted((r["doc_id"] for r in df.collect()), key=repr)

    one = corpus_pipeline.clean(spark, docs, SF)
    assert one.columns == names and sorted(one.collect(), key=repr) == sorted(docs.collect(), key=repr)
    two = corpus_pipeline.distinct_texts(spark, one, SF)
    assert two.columns == names and ids(two) == sorted([1, 2, None, None, None, 3, 4], key=repr)
    three = corpus_pipeline.private(spark, two, SF)
    got = three.collect()
    assert three.columns == names and len(got) == 7
    assert [r["text"] for r in got if r["text"] and "without" in r["text"]] == ["without an id, mail [EMAIL]"] * 2
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    four = corpus_pipeline.mixed(spark, three, SF)
    assert four.columns == names and sorted(four.collect(), key=repr) == sorted(got, key=repr)
    five = corpus_pipeline.segmented(spark, four, SF)
    assert five.columns == ["doc_id", "lang", "source", "n_chars", "mix_slot", "mix_place", "pieces"]
    assert sorted((len(r["pieces"]) > 0 for r in five.collect())) == [False] * 3 + [True] * 4
