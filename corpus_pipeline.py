"""A corpus pipeline in stages; every stage works on all that its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import jaccard, mix, pieces, pii, toxicity
from freshet.llm.queries import piece_model
from freshet.session import cut_lineage, ship


# Near duplicates of the pipeline share four fifths of their runs of five words.
NEAR_WORDS, NEAR_SHARE = 5, (80, 100)
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """A stage whose executors get the package with the job."""

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(ship(spark), docs, sf_dir)

    return run


@stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; the model is learned from the labels of this corpus.

    Every row is judged by its text alone, so repeated rows share their fate; a
    null text is empty and stays as it is, further columns and null ids too.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the Jaccard join, that with the smallest id; unlinked ones all stay.

    Rows that repeat an id and a text are one document, of which one row stays
    (any, if further columns differ); rows that share an id with different
    texts stay or go together. Rows with a null id, and null or empty texts,
    are linked with nothing.
    """
    classes = jaccard.classes(docs, size=NEAR_WORDS, threshold=NEAR_SHARE)
    others = classes.where("component_id <> doc_id").select("doc_id").distinct()
    repeated = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    kept = docs.join(others, "doc_id", "left_anti")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


@stage
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; ``n_chars`` follows the text.

    A null text stays null with a null ``n_chars``. Every row is treated by itself.
    """
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def _slots(docs: DataFrame) -> DataFrame:
    """(doc, mix_slot, mix_place) in the order of the mix; ``doc`` has the columns as they were, whatever their names."""
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return mix.interleave(rows, mix.tempered(docs)).select("doc", "mix_slot", "mix_place").orderBy("mix_slot", "mix_place")


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the mix of sources; all stay. A null source is a source of its own."""
    return _slots(docs).select("doc.*")


@stage
def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each text, with the columns that identify and describe it, in the order of the mix.

    Files are not reread in the order they were written in. The order follows
    from the rows alone and the mix keeps all of them, so it is made again here
    and returned as ``mix_slot`` and ``mix_place``. Columns of the input with
    the names of new ones give way to them; a null text has no pieces.
    """
    keep = [f"doc.`{c}`" for c in docs.columns if c not in ("mix_slot", "mix_place", "pieces")]
    slots = _slots(docs).select(*[F.col(c) for c in keep], "mix_slot", "mix_place")
    return pieces.encode(slots, piece_model(), rate=0.1, seed=1).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct_texts),
    ("PII", private),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", segmented),
]

# Learned scores, a learned field and seeded segmentations are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is kept in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
