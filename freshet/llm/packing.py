"""Packing of tokenised documents into sequences of about equal attention cost.

The cost of a piece of ``n`` tokens is estimated as ``12 * width * n + n * n``:
the matrix products of a layer grow with the tokens, causal attention with
their square. Documents go in descending order, each into the sequence of the
lowest cost so far that still has room for all of it. Documents longer than a
sequence are cut into whole sequences and a rest first. What fits nowhere as a
whole is cut: a part fills the sequence with most room, the rest waits for its
turn again.

The sequences of a group are made for exactly its tokens: whole ones, and for
what is left one sequence for each power of two in it. Such lengths need no
padding, so none is left over.

Documents are dealt into groups of about ``group_bytes`` of text by a hash of
id and text. A task packs the groups of its partition one after the other and
holds one at a time. A group that grows beyond twice its size (rows that repeat
id and text) is packed in several rounds.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import assets

LENGTH = 2048
END_ID = 1
WIDTH = 1024
GROUP_BYTES = 4 << 20

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.int64()), ("ids", pa.binary())]
)


# ---------------------------------------------------------------- tokens


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# The split into words of byte-level vocabularies (a fixed value of the format).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids by a vocabulary file of the ``tokenizers`` library, without special tokens added.

    A plain byte-level vocabulary whose ids follow its merges is run by a
    library that merges by rank, four times as fast with the same ids; what
    that one gives up on (endless runs of one kind of character) and any
    other vocabulary is encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = self._ranked(json.loads(open(path, encoding="utf-8").read()))

    @staticmethod
    def _ranked(file: dict):
        model, split, letters = file["model"], file.get("pre_tokenizer") or {}, _byte_letters()
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"}
        added = file.get("added_tokens") or []
        if (
            model.get("type") != "BPE"
            or file.get("normalizer")
            or any(model.get(k) for k in plain)
            or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True)
            or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
        ):
            return None
        vocab = model["vocab"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        special = {a["content"]: a["id"] for a in added}
        words = {w: i for w, i in vocab.items() if w not in special}
        if any(vocab.get(w) != 256 + k for k, w in enumerate(merged)) or len(words) != 256 + len(merged):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
        return tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- placement


def cost_of(n, width: int = WIDTH):
    """Estimated cost of a piece of ``n`` tokens; an integer."""
    return 12 * width * n + n * n


def rooms_for(tokens: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences of a group: whole ones, then the powers of two in what is left."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(sizes: list[int], length: int = LENGTH, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of ``sizes`` tokens.

    Equal lengths go in the order of the documents, equal costs to the first
    sequence. Every token is in one piece and every sequence is full.
    """
    rooms = rooms_for(sum(sizes), length)
    room = np.array(rooms, dtype=np.int64)
    cost = np.zeros(len(rooms), dtype=np.int64)
    never = np.iinfo(np.int64).max
    out = []

    def put(doc: int, start: int, n: int, at: int) -> None:
        out.append((doc, start, n, at, rooms[at] - int(room[at])))
        room[at] -= n
        cost[at] += cost_of(n, width)

    # Whole sequences come first in descending order; each opens one of its own.
    opened = 0
    waiting = []
    for doc, size in enumerate(sizes):
        for start in range(0, size - length + 1, length):
            put(doc, start, length, opened)
            opened += 1
        if size % length:
            waiting.append((-(size % length), doc, size - size % length))
    heapq.heapify(waiting)
    while waiting:
        n, doc, start = heapq.heappop(waiting)
        n = -n
        at = int(np.where(room >= n, cost, never).argmin())
        if room[at] >= n:
            put(doc, start, n, at)
            continue
        most = int(room.max())
        put(doc, start, most, int(np.where(room == most, cost, never).argmin()))
        heapq.heappush(waiting, (most - n, doc, start + most))
    return out


# ---------------------------------------------------------------- on Spark


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    length: int = LENGTH,
    end_id: int = END_ID,
    width: int = WIDTH,
    group_bytes: int = GROUP_BYTES,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, cost, ids): one row a piece.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit
    integers; each document ends with ``end_id``, which ``doc_tokens`` counts.
    ``offset`` runs without gaps in each sequence. A null text is empty (its
    document is ``end_id`` alone), a null id stays null, repeated rows are
    documents of their own, other columns play no part and an empty table has
    no pieces. The result depends on the rows and the parameters only, not on
    how Spark deals them out.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    name = assets.send(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    order = F.xxhash64("doc_id", "text")
    rows = rows.withColumns({"h": order, "g": F.pmod(order, F.lit(groups))})
    dealt = rows.repartition("g").sortWithinPartitions("g", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(assets.place(name))
        group, held, size, made = None, [], 0, 0
        for batch in batches:
            ids, texts, marks = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("g").to_pylist()
            for k, g in enumerate(marks):
                if g != group or size > 2 * group_bytes:
                    yield from _packed(held, group, groups, made, length, width)
                    made = made + len(rooms_for(sum(len(x[2]) for x in held), length)) if g == group else 0
                    group, held, size = g, [], 0
                t = texts[k].as_py()
                held.append((ids[k], t, np.append(encode(t), np.uint32(end_id)).astype("<u4")))
                size += len(t)
        yield from _packed(held, group, groups, made, length, width)

    return dealt.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost long, ids binary")


def _packed(held: list, group: int | None, groups: int, made: int, length: int, width: int) -> Iterator[pa.RecordBatch]:
    """The pieces of one group; its sequences are numbered ``group``, ``group + groups``, ... from the ``made``-th on."""
    held.sort(key=lambda x: (-len(x[2]), x[0] is not None, x[0] or 0, x[1]))
    pieces = assign([len(x[2]) for x in held], length, width)
    for lo in range(0, len(pieces), 4096):
        rows = pieces[lo : lo + 4096]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": [held[d][0] for d, *_ in rows],
                "start": [s for _, s, *_ in rows],
                "length": [n for _, _, n, *_ in rows],
                "doc_tokens": [len(held[d][2]) for d, *_ in rows],
                "sequence_id": [group + groups * (made + q) for *_, q, _ in rows],
                "offset": [o for *_, o in rows],
                "cost": [cost_of(n, width) for _, _, n, *_ in rows],
                "ids": [held[d][2][s : s + n].tobytes() for d, s, n, *_ in rows],
            },
            schema=PIECES,
        )


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, n_tokens, padded_to, cost, lengths, ids): the packed sequences, their pieces' lengths in order.

    At most ``length`` tokens meet in a row. A sequence whose tokens are a
    power of two is not padded, any other is padded to ``length``; ``ids``
    comes without padding.
    """
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "cost", F.hex("ids").alias("ids")))).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    own = own.withColumn("n_tokens", total)
    return own.select(
        "sequence_id",
        "n_tokens",
        F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, F.col("n_tokens")).otherwise(F.lit(length).cast("long")).alias("padded_to"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["cost"]).alias("cost"),
        F.transform("p", lambda x: x["length"]).alias("lengths"),
        F.unhex(F.array_join(F.transform("p", lambda x: x["ids"]), "")).alias("ids"),
    )
