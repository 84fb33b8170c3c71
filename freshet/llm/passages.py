"""Removal of repeated passages by sliding sentence spans.

Every text is cut into sentences, very long ones at words that their own
letters choose, so that shared parts are cut alike. Each run of at least
``RUN_SENTENCES`` sentences and ``RUN_WORDS`` words, or of fewer sentences and
``ALONE_WORDS`` words, that has no shorter such run at its start or at its end
gets a hash. Over all texts the first occurrence of each hash (by
id, then place) stays; sentences that any later occurrence covers are removed.

Runs are reduced to counts before they move, so a passage that a third of all
texts hold is one row a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.kernel import _LOWER, _power, blocks, mix, span_hashes, words
from freshet.session import cut_lineage

RUN_SENTENCES = 3
RUN_WORDS = 12
ALONE_WORDS = 40
LONG_SENTENCE = 64  # words from which a sentence is cut
CUT_EVERY = 31  # words between such cuts, about
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:;"]] = True
_BASE, _INVERSE = 0x8D12A9F0B3C4E567 | 1, pow(0x8D12A9F0B3C4E567 | 1, -1, 1 << 64)


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, number of each sentence's first word, number of each text's first sentence).

    A sentence begins with a text, after a word that ends in one of ``.!?:;``,
    after a line break, and at a word with a leading capital (A-Z or a Latin-1
    one) that follows another word: passages are often set into running text.
    Sentences of more than ``LONG_SENTENCE`` words also begin anew at words
    whose lower-cased bytes add up to 7 more than a multiple of ``CUT_EVERY``.
    """
    starts, ends, first_word = words(data, at)
    n = len(starts)
    fresh = np.zeros(n, dtype=bool)
    if n:
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        lead = data[starts]
        second = data[np.minimum(starts + 1, len(data) - 1)]
        fresh[1:] = _ENDS[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
        fresh |= ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        fresh[first_word[:-1][first_word[:-1] < first_word[1:]]] = True
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, n))
        if (size > LONG_SENTENCE).any():
            upto = np.concatenate(([0], np.cumsum(_LOWER[data].astype(np.int64))))
            fresh |= np.repeat(size > LONG_SENTENCE, size) & ((upto[ends] - upto[starts]) % CUT_EVERY == 7)
    first = np.flatnonzero(fresh)
    return starts, ends, first, np.searchsorted(first, first_word)


def runs(data: np.ndarray, at: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence, end sentence, hash) of every run; sentences are numbered from 0 in their text."""
    starts, ends, first, of_text = sentences(data, at)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    h = mix(span_hashes(_LOWER[data], starts, ends) + np.uint64(_BASE))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _power(_BASE, len(h), "runs up")[: len(h)], out=total[1:])
    edge = np.append(first, len(starts))  # word where a sentence begins
    text = np.repeat(np.arange(len(at) - 1), np.diff(of_text))
    low, high = of_text[:-1][text], of_text[1:][text]
    s = np.arange(len(first))
    keys = []
    for sentences_, words_, most in ((*least, None), (1, ALONE_WORDS, least[0])):
        forward = np.maximum(s + sentences_, np.searchsorted(edge, edge[:-1] + words_, side="left"))
        back = np.minimum(s + 1 - sentences_, np.searchsorted(edge, edge[1:] - words_, side="right") - 1)
        a, b = forward <= high, back >= low
        if most is not None:
            # Longer ones are runs of the first kind already.
            a, b = a & (forward - s < most), b & (s + 1 - back < most)
        keys += [s[a] << 32 | forward[a], back[b] << 32 | (s[b] + 1)]
    key = np.unique(np.concatenate(keys))
    x, y = key >> 32, key & 0xFFFFFFFF
    value = (total[edge[y]] - total[edge[x]]) * _power(_INVERSE, len(h) + 1, "runs down")[edge[x]]
    return text[x], x - low[x], y - low[x], mix(value + (edge[y] - edge[x]).astype(np.uint64))


def spans(docs: DataFrame, least: tuple[int, int] = (RUN_SENTENCES, RUN_WORDS)) -> DataFrame:
    """(h, doc_id, s, e) of every run of every text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, data, at in blocks(batch.column("text")):
                text, s, e, h = runs(data, at, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[lo:hi][text]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
                    names=["h", "doc_id", "s", "e"],
                )

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "h long, doc_id long, s int, e int")


HOT_SHARE = 4096


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, s, e) of the occurrences after the first of each hash.

    At most ``HOT_SHARE`` hashes can each have more than that share of all
    rows. They are sent to the tasks, so the rows of a passage that very many
    texts hold stay where they are; the others meet their first occurrence in
    a join.
    """
    firsts = found.groupBy("h").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = cut_lineage(firsts.select("h", F.col("first.doc_id").alias("d0"), F.col("first.s").alias("s0"), "n"))
    many = (firsts.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = firsts.where(F.col("n") > many).select("h", F.col("d0").alias("hot_d0"), F.col("s0").alias("hot_s0"))
    rows = found.join(F.broadcast(hot), "h", "left")
    # Rows of hot hashes go on under keys of their own, evenly dealt, and their match is not used.
    rows = rows.withColumn("k", F.when(F.col("hot_d0").isNull(), F.col("h")).otherwise(F.xxhash64("doc_id", "s", "e")))
    rows = rows.drop("h").join(firsts.where(F.col("n") <= many).select(F.col("h").alias("k"), "d0", "s0"), "k", "left")
    rows = rows.withColumns({"d0": F.coalesce("hot_d0", "d0"), "s0": F.coalesce("hot_s0", "s0")})
    return rows.where("d0 IS NOT NULL AND (doc_id <> d0 OR s <> s0)").select("doc_id", "s", "e")


def without_repeats(docs: DataFrame, least: tuple[int, int] = (RUN_SENTENCES, RUN_WORDS)) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its text free of repeated passages.

    Returns doc_id, n_sentences, n_removed and text. What stays keeps its white
    space; a text may become empty, its row stays. Case of A-Z and white space
    do not tell passages apart. A null text becomes empty. Rows with a null id
    are returned as they are, and rows that repeat an id count as one text.
    Other columns are ignored.
    """
    marks = repeated(spans(docs, least)).groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("gone"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks, "doc_id", "left")

    def run(batches):
        for batch in batches:
            ids, gone = batch.column("doc_id"), batch.column("gone")
            for lo, hi, data, at in blocks(batch.column("text")):
                starts, _, first, of_text = sentences(data, at)
                n, removed, texts = np.diff(of_text), [], []
                for i in range(hi - lo):
                    spot = gone[lo + i]
                    if not spot.is_valid:
                        removed.append(0)
                        texts.append(data[at[i] : at[i + 1]].tobytes().decode("utf-8"))
                        continue
                    off = np.zeros(n[i], dtype=bool)
                    for x in spot.as_py():
                        off[x["s"] : x["e"]] = True
                    # A sentence reaches to the start of the next one; the first also has what stands before it.
                    cuts = np.append(starts[first[of_text[i] : of_text[i + 1]]], at[i + 1])
                    if len(cuts) > 1:
                        cuts[0] = at[i]
                    removed.append(int(off.sum()))
                    texts.append(b"".join(data[cuts[k] : cuts[k + 1]].tobytes() for k in np.flatnonzero(~off)).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_sentences", "n_removed", "text"],
                )

    return rows.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, text string")
