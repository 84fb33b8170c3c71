"""SentencePiece merge segmentation with seeded merge-dropout, and its exact inverse.

The vocabulary is that of a given model file; nothing is trained. A text gets a
leading space and is cut into single characters; the best-scored merge of two
neighbours, the leftmost of equals, is made again and again. A candidate merge
is skipped where a hash keyed by the seed, the document, the place and both
pieces falls below the dropout rate, so a text has many segmentations and each
seed always gives the same one. Decoding joins the pieces and drops the leading space;
characters outside the vocabulary are written as their UTF-8 bytes.

No merge can cross two neighbouring characters that no piece holds side by
side. Texts are cut there into chunks, and a block's distinct chunks are merged
together without dropout as rows of a matrix, one merge a row and round. Every
occurrence of a chunk has a key of its own, by seed, document and place. Where
its draws skip none of the merges that were made, leaving out others changes
nothing, and it shares the outcome; all other occurrences are merged by
themselves. Chunks too long for a matrix go through an agenda (a heap of
candidate merges) with the same outcome.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm import assets
from freshet.llm.kernel import blocks, mix

BLOCK = 1 << 19
MATRIX_WIDTH = 32
NONE = np.int32(2**31 - 1)
SPACE = "▁"

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass
class Vocabulary:
    """Tables of a model: pieces as bytes, merges by pair, and which characters may stand side by side in a piece."""

    char_id: np.ndarray  # piece of each code point, -1 for none
    char_class: np.ndarray  # dense number of the characters in longer pieces, 0 for others
    beside: np.ndarray  # [class, class]: some piece holds them in this order
    slots: np.ndarray  # hash table of pair keys, -1 for empty
    merged: np.ndarray  # piece of each slot's merge
    rank: np.ndarray  # order of each piece's score, 0 for the best
    byte_id: np.ndarray
    bytes_: np.ndarray  # all pieces' bytes, one after the other
    start: np.ndarray
    size: np.ndarray

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pieces made of two neighbours, -1 for none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        mask = np.uint64(len(self.slots) - 1)
        at = (mix(key.view(np.uint64)) & mask).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.slots[at[open_]]
            same = found == key[open_]
            out[open_[same]] = self.merged[at[open_[same]]]
            open_ = open_[~same & (found != -1)]
            at[open_] = (at[open_] + 1) & np.int64(mask)
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    """Tables of a model file, made once in each worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    byte_id = np.zeros(256, dtype=np.int32)
    normal, texts = {}, []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"")
        else:
            normal[piece] = i
            texts.append(piece.replace(SPACE, " ").encode())
    char_id = np.full(0x110000, -1, dtype=np.int32)
    for piece, i in normal.items():
        if len(piece) == 1:
            char_id[ord(" ") if piece == SPACE else ord(piece)] = i
    chars = sorted({c for p in normal if len(p) > 1 for c in p})
    char_class = np.zeros(0x110000, dtype=np.int32)
    for k, c in enumerate(chars):
        char_class[ord(" ") if c == SPACE else ord(c)] = k + 1
    beside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
    slots = np.full(1 << 20, -1, dtype=np.int64)
    merged = np.zeros(1 << 20, dtype=np.int32)
    place = {c: k + 1 for k, c in enumerate(chars)}
    for piece, i in normal.items():
        for a, b in zip(piece[:-1], piece[1:], strict=True):
            beside[place[a], place[b]] = True
        for k in range(1, len(piece)):
            left, right = normal.get(piece[:k]), normal.get(piece[k:])
            if left is not None and right is not None:
                key = left << 32 | right
                at = int(mix(np.array([key], dtype=np.uint64))[0]) & (len(slots) - 1)
                while slots[at] != -1:
                    at = (at + 1) & (len(slots) - 1)
                slots[at], merged[at] = key, i
    scores = np.array([sp.get_score(i) for i in range(n)])
    _, rank = np.unique(-scores, return_inverse=True)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    return Vocabulary(char_id, char_class, beside, slots, merged, rank.astype(np.int32), byte_id, np.frombuffer(b"".join(texts), np.uint8), start, size)


def drawn(h: np.ndarray, doc: np.ndarray, spot: np.ndarray, seed: int) -> np.ndarray:
    """A key of each occurrence of a chunk: its hash, the document's key and the chunk's number in the document."""
    salt = np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(h + mix(mix(mix(doc + salt) + spot * _K[0]) + salt + np.uint64(1)))


def dropped(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, rate: float) -> np.ndarray:
    """Whether candidate merges are skipped: a hash of the chunk's key, the left piece's place in it and both pieces."""
    h = mix(key + place.astype(np.uint64) * _K[0] + mix(left.astype(np.uint64) * _K[1] + right.astype(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < rate * float(1 << 53)


def _ranks(v: Vocabulary, key, place, left, right, rate: float):
    """Rank of each candidate merge, NONE where there is none or it is skipped; and the merged piece."""
    piece = v.lookup(left, right)
    rank = np.where(piece >= 0, v.rank[np.maximum(piece, 0)], NONE)
    if rate > 0:
        some = np.flatnonzero(piece >= 0)
        gone = dropped(key[some], place[some], left[some], right[some], rate)
        rank[some[gone]] = NONE
    return rank, piece


def _merge_rows(v: Vocabulary, sym: np.ndarray, size: np.ndarray, key: np.ndarray, rate: float, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge all rows of a matrix of piece numbers; returns it packed to the left, and the sizes.

    ``made`` gets the merges of each round as (rows, places, left pieces, right pieces).
    """
    rows, width = sym.shape
    place = np.broadcast_to(np.arange(width, dtype=np.int16), sym.shape).copy()
    rank = np.full((rows, max(1, width - 1)), NONE, dtype=np.int32)
    piece = np.full(rank.shape, -1, dtype=np.int32)
    r, c = np.nonzero(np.arange(width - 1)[None, :] < (size - 1)[:, None])
    if len(r):
        rank[r, c], piece[r, c] = _ranks(v, key[r], place[r, c], sym[r, c], sym[r, c + 1], rate)
    live = np.arange(rows)
    out, out_size = sym.copy(), size.copy()
    cols, pair_cols = np.arange(width)[None, :], np.arange(rank.shape[1])[None, :]
    while True:
        at = rank.argmin(axis=1)
        go = rank[np.arange(len(live)), at] != NONE
        stop = ~go
        if stop.any():
            out[live[stop]], out_size[live[stop]] = sym[stop], size[stop]
            live, sym, size, place, rank, piece, key, at = (x[go] for x in (live, sym, size, place, rank, piece, key, at))
        if not len(live):
            return out, out_size
        n = np.arange(len(live))
        new = piece[n, at]
        if made is not None:
            made.append((live, place[n, at], sym[n, at], sym[n, at + 1]))
        # Take out the right one of each merged pair.
        move = np.minimum(cols + (cols > at[:, None]), width - 1)
        sym, place = np.take_along_axis(sym, move, 1), np.take_along_axis(place, move, 1)
        sym[n, at] = new
        move = np.minimum(pair_cols + (pair_cols > at[:, None]), rank.shape[1] - 1)
        rank, piece = np.take_along_axis(rank, move, 1), np.take_along_axis(piece, move, 1)
        size = size - 1
        rank[n, np.minimum(size - 1, rank.shape[1] - 1)] = NONE
        for d in (-1, 0):
            i = at + d
            ok = np.flatnonzero((i >= 0) & (i + 1 < size))
            if len(ok):
                j = i[ok]
                rank[ok, j], piece[ok, j] = _ranks(v, key[ok], place[ok, j], sym[ok, j], sym[ok, j + 1], rate)


def _merge_long(v: Vocabulary, sym: np.ndarray, key: np.uint64, rate: float, made: list | None = None) -> np.ndarray:
    """The same for one long chunk, by an agenda of candidate merges; ``made`` gets each merge as (place, left piece, right piece)."""
    n = len(sym)
    ids = sym.tolist()
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list[tuple[int, int, int, int, int, int]] = []

    def offer(pairs: list[tuple[int, int]]):
        a, b = np.array([ids[i] for i, _ in pairs]), np.array([ids[j] for _, j in pairs])
        rank, piece = _ranks(v, np.full(len(a), key), np.array([i for i, _ in pairs]), a, b, rate)
        for (i, j), r, p in zip(pairs, rank.tolist(), piece.tolist(), strict=True):
            if r != NONE:
                heapq.heappush(agenda, (r, i, j, ids[i], ids[j], p))

    if n > 1:
        offer([(i, i + 1) for i in range(n - 1)])
    while agenda:
        _, i, j, a, b, p = heapq.heappop(agenda)
        if ids[i] != a or ids[j] != b or right[i] != j:
            continue
        if made is not None:
            made.append((i, a, b))
        ids[i], ids[j] = p, -2
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        near = [(x, y) for x, y in ((left[i], i), (i, right[i])) if x >= 0 and y >= 0]
        if near:
            offer(near)
    return np.array([x for x in ids if x != -2], dtype=np.int32)


def _segment(v: Vocabulary, codes: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray, rate: float, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, number of pieces a chunk) of chunks given by start and size; ``made`` gets (chunks, places, left pieces, right pieces)."""
    out_ids: list[np.ndarray] = [np.zeros(0, np.int32)]
    out_rows: list[np.ndarray] = [np.zeros(0, np.int64)]
    out_sizes = np.zeros(len(first), dtype=np.int64)
    # A chunk of one character cannot be merged.
    one = np.flatnonzero(size == 1)
    single = v.char_id[codes[first[one]]]
    known = one[single >= 0]
    out_ids.append(single[single >= 0])
    out_rows.append(known)
    out_sizes[known] = 1
    strange = one[single < 0]
    for u in strange.tolist():
        raw = v.byte_id[np.frombuffer(chr(int(codes[first[u]])).encode("utf-8", "surrogatepass"), np.uint8)]
        out_ids.append(raw)
        out_rows.append(np.full(len(raw), u))
        out_sizes[u] = len(raw)
    low = 2
    for width in (4, 6, 8, 12, 16, 24, MATRIX_WIDTH):
        rows = np.flatnonzero((size >= low) & (size <= width))
        low = width + 1
        for lo in range(0, len(rows), 50_000):
            part = rows[lo : lo + 50_000]
            cols = np.arange(width)[None, :]
            spot = np.minimum(first[part][:, None] + cols, len(codes) - 1)
            sym = v.char_id[codes[spot]]
            own: list | None = None if made is None else []
            sym, got = _merge_rows(v, sym, size[part].copy(), key[part], rate, own)
            if made is not None:
                made.extend((part[live], *rest) for live, *rest in own)
            keep = cols < got[:, None]
            out_ids.append(sym[keep])
            out_rows.append(np.repeat(part, got))
            out_sizes[part] = got
    for u in np.flatnonzero(size >= low).tolist():
        own = None if made is None else []
        ids = _merge_long(v, v.char_id[codes[first[u] : first[u] + size[u]]], key[u], rate, own)
        if own:
            made.append((np.full(len(own), u), *np.array(own).T))
        out_ids.append(ids)
        out_rows.append(np.full(len(ids), u))
        out_sizes[u] = len(ids)
    rows = np.concatenate(out_rows)
    return np.concatenate(out_ids)[np.argsort(rows, kind="stable")], out_sizes


def _skipping(made: list, which: np.ndarray, chunks: int, key: np.ndarray, rate: float) -> np.ndarray:
    """The occurrences whose draws skip a merge that their chunk made; ``which`` is the chunk and ``key`` the key of each."""
    if not made:
        return np.zeros(0, dtype=np.int64)
    row, place, left, right = (np.concatenate(x) for x in zip(*made, strict=True))
    order = np.argsort(row, kind="stable")
    place, left, right = place[order], left[order], right[order]
    count = np.bincount(row, minlength=chunks)
    begin = np.cumsum(count) - count
    out = []
    some = np.flatnonzero(count[which])
    ends = np.cumsum(count[which[some]])
    # About a million draws at once.
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 1 << 20)), len(some)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        occ = some[lo:hi]
        n = count[which[occ]]
        stop = np.cumsum(n)
        pick = np.arange(stop[-1]) - np.repeat(stop - n, n) + np.repeat(begin[which[occ]], n)
        gone = dropped(np.repeat(key[occ], n), place[pick], left[pick], right[pick], rate)
        out.append(occ[np.logical_or.reduceat(gone, stop - n)])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def encode_block(v: Vocabulary, texts: np.ndarray, at: np.ndarray, key: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, offsets) of texts given as code points; ``key`` is a number a document."""
    n = len(at) - 1
    full = np.diff(at) > 0
    # A leading space for each text that is not empty.
    put = at[:-1][full]
    codes = np.insert(texts, put, 32)
    begin = at + np.concatenate(([0], np.cumsum(full)))
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    kind = v.char_class[codes]
    fresh = np.empty(len(codes), dtype=bool)
    fresh[0] = True
    fresh[1:] = ~v.beside[kind[:-1], kind[1:]]
    fresh[begin[:-1][full]] = True
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(codes)))
    # 64-bit hashes of the chunks: position-weighted sums, places counted from a chunk's start.
    inner = (np.arange(len(codes)) - np.repeat(first, size)).astype(np.uint64)
    h = mix(np.add.reduceat(mix(codes.astype(np.uint64) * _K[2] + inner * _K[1]), first) + size.astype(np.uint64))
    doc = np.searchsorted(begin, first, side="right") - 1
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    made: list | None = [] if rate > 0 else None
    flat, out_sizes = _segment(v, codes, first[where], size[where], h[where], 0.0, made)
    if rate > 0:
        spot = np.arange(len(first), dtype=np.uint64) - np.searchsorted(first, begin[:-1]).astype(np.uint64)[doc]
        own_key = drawn(h, key[doc], spot, seed)
        own = _skipping(made, which, len(where), own_key, rate)
        more, sizes = _segment(v, codes, first[own], size[own], own_key[own], rate)
        which[own] = len(where) + np.arange(len(own))
        flat, out_sizes = np.concatenate((flat, more)), np.concatenate((out_sizes, sizes))
    u_at = np.concatenate(([0], np.cumsum(out_sizes)[:-1]))
    counts = out_sizes[which]
    ends = np.cumsum(counts)
    pick = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(u_at[which], counts)
    bounds = np.concatenate(([0], ends))[np.searchsorted(first, begin)]
    return flat[pick].astype(np.int32), bounds


def decode_block(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of lists of pieces."""
    size = v.size[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    pick = np.arange(total) - np.repeat(ends - size, size) + np.repeat(v.start[ids], size)
    data = v.bytes_[pick]
    bounds = np.concatenate(([0], ends))[at]
    # The leading space of each text that has pieces.
    full = np.diff(at) > 0
    data = np.delete(data, bounds[:-1][full])
    return data, bounds - np.concatenate(([0], np.cumsum(full)))


def encode(docs: DataFrame, model: str, *, rate: float = 0.1, seed: int = 1, text: str = "text", row_id: str = "doc_id", out: str = "pieces") -> DataFrame:
    """Add ``out``: the text's piece numbers. A null text has none, like an empty one; an old column ``out`` is replaced.

    The seed and the id draw the segmentation, so rows that repeat an id and a
    text repeat their pieces; a null id is a key of its own. A rate of 0 gives
    the model's own best segmentation.
    """
    keep = [f.name for f in docs.schema.fields if f.name != out]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(F.col(f"`{row_id}`").cast("string")).alias("_key"))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType()))])

    name = assets.send(docs.sparkSession, model)

    def run(batches):
        v = vocabulary(assets.place(name))
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            for lo, hi, data, at in blocks(col, BLOCK):
                # Code points start at bytes that do not continue one.
                codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
                heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                ids, bounds = encode_block(v, codes, heads[at], keys[lo:hi], rate, seed)
                found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*keep, out])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, *, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the pieces. Null or empty lists give the empty text; an old column ``out`` is replaced."""
    keep = [f.name for f in encoded.schema.fields if f.name != out]
    rows = encoded.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField(out, T.StringType())])

    name = assets.send(encoded.sparkSession, model)

    def run(batches):
        v = vocabulary(assets.place(name))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(pieces))
            ids, sizes = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
            at = np.concatenate(([0], np.cumsum(sizes)))
            row = 0
            while row < len(sizes):
                end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK // 2, side="right")) - 1)
                data, bounds = decode_block(v, ids[at[row] : at[end]], at[row : end + 1] - at[row])
                texts = pa.Array.from_buffers(pa.string(), end - row, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*keep, out])
                row = end

    return rows.mapInArrow(run, schema)


