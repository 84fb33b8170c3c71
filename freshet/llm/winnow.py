"""Document fingerprints by winnowing, in DataFrame operations only.

A text is cut into tokens, every run of ``k`` tokens gets a hash, and from each
window of ``w`` consecutive hashes the smallest is kept, the rightmost of
equals. Two texts that share a run of at least ``w + k - 1`` tokens share a
kept hash; positions say where. Rolling hashes and window minima are both
built by doubling over shifted arrays, so a text costs a few array passes
whatever ``k`` and ``w``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS_PER_GRAM = 3
GRAMS_PER_WINDOW = 4
# A token is a run of word characters, at most so many: text without spaces still gets many.
# Scripts that are written without spaces give one token a character.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]|[\p{L}\p{M}\p{N}_]{1,16}"
ROWS_PER_BUCKET = 2000
MOST_BUCKETS = 1 << 14

_HASH_BITS = 36
_PLACES = (1 << 27) - 1  # tokens of a text whose positions are told apart


def _widened(df: DataFrame, name: str, width: int, both) -> DataFrame:
    """Replace the array by one that combines ``width`` neighbours at each place, in log2(width) passes.

    Each pass combines the value at a place with the one ``add`` places on, so
    every result is the same function of its ``width`` neighbours.
    """
    have = 1
    while have < width:
        add = min(have, width - have)
        df = df.withColumn("_shift", F.slice(F.col(name), F.lit(add + 1), F.greatest(F.size(name) - add, F.lit(0))))
        df = df.withColumn(name, F.zip_with(F.slice(F.col(name), F.lit(1), F.size("_shift")), "_shift", both))
        have += add
    return df.drop("_shift")


def fingerprints(df: DataFrame, text: str, out: str, k: int = TOKENS_PER_GRAM, w: int = GRAMS_PER_WINDOW) -> DataFrame:
    """Add ``out``: array of ``hash << 27 | (2^27 - 1 - position)``, in order of position, positions from 0.

    A text of fewer than ``k`` tokens has one gram of all it has; of fewer
    than ``w`` grams one window. A text without tokens, or null, has an empty
    fingerprint. Hashes are of tokens as they are written, case included.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    df = df.withColumn(out, F.transform(tokens, lambda t: F.xxhash64(t)))
    df = df.withColumn("_short", F.when((F.size(out) > 0) & (F.size(out) < k), F.array(F.xxhash64(F.col(out)))))
    df = _widened(df, out, k, lambda a, b: F.xxhash64(a, b))
    low = F.lit((1 << _HASH_BITS) - 1)
    packed = F.transform(
        F.coalesce("_short", out),
        lambda h, i: F.shiftleft(h.bitwiseAND(low), 27).bitwiseOR(F.lit(_PLACES) - F.pmod(i.cast("long"), F.lit(_PLACES + 1))),
    )
    # Of packed values the smallest has the smallest hash and, of equals, is the rightmost.
    df = df.withColumn(out, packed)
    df = df.withColumn("_short", F.when((F.size(out) > 0) & (F.size(out) <= w), F.array(F.array_min(out))))
    df = _widened(df, out, w, lambda a, b: F.least(a, b))
    # Minima of neighbouring windows that are the same gram stand next to each other.
    last = F.slice(F.concat(F.array(F.lit(-1).cast("long")), F.col(out)), F.lit(1), F.size(out))
    df = df.withColumn("_last", last)
    df = df.withColumn(out, F.coalesce("_short", F.array_compact(F.zip_with(out, "_last", lambda a, b: F.when(a != b, a)))))
    return df.drop("_short", "_last")


def as_text(packed: str) -> Column:
    """``position:hash`` of each kept gram, joined by commas."""
    return F.array_join(
        F.transform(
            packed,
            lambda x: F.concat((F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(x, 27)))),
        ),
        ",",
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike (1.0)."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(bucket, own, doc_id, text) rows in ranges of about 2,000 ids, and the window that orders a range.

    The first row of every range also stands in the range before it as a
    visitor (``own`` false), so ``lead`` finds each row's successor without
    one task seeing all rows and with a single move of the texts. The bounds
    are ids of the table, 16,384 at most; a few numbers reach the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("own").desc(), F.col("text")]
    ids = docs.select("doc_id").where("doc_id is not null")
    size = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).first()
    buckets = max(1, min(MOST_BUCKETS, -(-size["n"] // ROWS_PER_BUCKET)))
    bounds = []
    if buckets > 1:
        at = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets))), ",").cast("array<double>")
        bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", at, F.lit(max(10_000, 4 * buckets)))).first()[0]) - {size["low"]})
    window = Window.partitionBy("bucket").orderBy(*order)
    if not bounds:
        first = docs.agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("r"))
        first = first.where("r is not null").select(F.lit(1).alias("k"), F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"))
        own = docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("late"), F.lit(True).alias("own"), "doc_id", "text")
        guest = first.select(F.lit(0).alias("bucket"), F.lit(1).alias("late"), F.lit(False).alias("own"), "doc_id", "text")
        return own.unionByName(guest), Window.partitionBy("bucket").orderBy("late", *order)
    edges = F.split(F.lit(",".join(str(int(b)) for b in bounds)), ",").cast("array<bigint>")
    own = docs.withColumn("_edges", edges)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    # Number of bounds <= doc_id, by bisection; a null id is before all.
    found = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
            F.element_at("_edges", F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1) <= F.col("doc_id"),
            F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")),
        ).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))),
    )["lo"]
    own = own.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(found)).drop("_edges")
    own = own.withColumn("late", F.lit(0)).withColumn("own", F.lit(True))
    heads = docs.sparkSession.createDataFrame([(int(b), i) for i, b in enumerate(bounds)], "h long, bucket int")
    guest = docs.join(F.broadcast(heads), F.col("doc_id") == F.col("h")).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    start = docs.where("doc_id is null" if _has_null(docs) else F.col("doc_id") == size["low"]).agg(F.min("text").alias("text"))
    head = start.select(F.lit(len(bounds)).alias("bucket"), F.lit(None if _has_null(docs) else size["low"]).cast("long").alias("doc_id"), "text")
    guest = guest.unionByName(head).select("bucket", "doc_id", "text", F.lit(1).alias("late"), F.lit(False).alias("own"))
    return own.unionByName(guest), Window.partitionBy("bucket").orderBy("late", *order)


def _has_null(docs: DataFrame) -> bool:
    return not docs.where("doc_id is null").isEmpty()


def compare_neighbours(docs: DataFrame, k: int = TOKENS_PER_GRAM, w: int = GRAMS_PER_WINDOW) -> DataFrame:
    """Fingerprints of every text, of an edited one, and their likeness.

    Returns doc_id, n_chars, edited, fp, edited_fp (packed arrays),
    near_edited and near_next. The edited text has its last half (rounded
    down) replaced by the first as many code points of the next document in
    ascending doc_id; the last document's next is the first. A null text is
    empty, null ids come first, and rows of one id follow each other by text.
    A lone document is its own next. Other columns are ignored.
    """
    rows, window = with_next(docs)
    rows = rows.withColumn("after", F.lead("text").over(window))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("after", F.lit(1), half))
    rows = rows.withColumn("edited", F.when(F.col("own"), edited))
    rows = fingerprints(rows, "text", "fp", k, w)
    rows = fingerprints(rows, "edited", "edited_fp", k, w)
    hashes = lambda c: F.array_distinct(F.transform(c, lambda x: F.shiftrightunsigned(x, 27)))
    rows = rows.withColumns({"_hash": hashes("fp"), "_ehash": hashes("edited_fp")})
    rows = rows.withColumn("_next", F.lead("_hash").over(window))
    return rows.where("own").select(
        "doc_id", "n_chars", "edited", "fp", "edited_fp", likeness("_hash", "_ehash").alias("near_edited"), likeness("_hash", "_next").alias("near_next")
    )
