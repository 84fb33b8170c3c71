"""Exact Jaccard self-join of word shingle sets, and the classes its links make.

1. Copies: texts with the same set (size and a 128-bit sum of its hashes) are
   one node from here on.
2. Tiles: a set is filed under its rarest shingles (as many as leave no pair
   above the threshold without a shared one) and its size band, a power of two;
   a set near its band's end also stands in the next one.
3. Signatures: a pair from a tile must pass a bound on its overlap from the bit
   counts of two hashed bitmaps of four to eight bits a shingle. Tiles of many
   members bring them along, the others shorter ones.
4. Proof: what passes is decided by intersecting the two sorted arrays.

Rarity comes from counts of all shingles in 2^20 hashed cells, so any order of
ties is still the same order everywhere, which is all that exactness needs.

A tile never emits all its pairs. First each member is tried with the likeliest
partner of each of its tiles only; then tiles whose members are all in one class are done. In the rest
short bitmaps of pairs of different classes are compared where the tile is, and
a pair that passes is emitted by few of the tiles it shares. A tile of more than
``TILE_ROWS`` members is dealt out as cells of two of its parts each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.graph import components
from freshet.llm.kernel import blocks, list_array, mix, shingles
from freshet.session import cut_lineage

SHINGLE_WORDS = 4
THRESHOLD = (85, 100)
CELLS = 1 << 20
CELL_BLOCK = 1 << 14
TILE_ROWS = 2048
# From so many members on, the rows of a tile bring longer bitmaps, of at most so many bytes.
CROWD_ROWS, WIDE_BYTES = 8, 512
SMALL_IDS = 4_000_000  # ids that may be broadcast: 32 MB


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """For each of 2^20 hash cells, a class from 0 to 255 that grows with the documents that hold its shingles.

    Each task adds up a fixed array; the arrays are added in two levels of
    groups. The result is one byte a cell, 1 MB whatever the input.
    """

    def count(batches):
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, data, at in blocks(_column(batch, "text")):
                own = list(shingles(data, at, size))
                cells += np.bincount((np.concatenate(own) >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        task = int(cells.sum()) % 61
        for lo in range(0, CELLS, CELL_BLOCK):
            part = cells[lo : lo + CELL_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // CELL_BLOCK], pa.int32()), pa.array([task], pa.int32()), pa.array([part.tobytes()])], names=["block", "slot", "n"])

    def add(batches):
        total, block, slot = np.zeros(CELL_BLOCK, dtype=np.int64), 0, 0
        for batch in batches:
            for b, s, n in zip(*(batch.column(c).to_pylist() for c in ("block", "slot", "n")), strict=True):
                total += np.frombuffer(n, dtype=np.int64)
                block, slot = b, s
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([slot], pa.int32()), pa.array([total.tobytes()])], names=["block", "slot", "n"])

    kind = "block int, slot int, n binary"
    counts = texts.select("text").mapInArrow(count, kind)
    sums = counts.groupBy("block", "slot").applyInArrow(_streamed(add), kind).groupBy("block").applyInArrow(_streamed(add), kind)
    out = np.zeros(CELLS, dtype=np.uint8)
    for r in sums.toLocalIterator():
        n = np.frombuffer(bytes(r["n"]), dtype=np.int64)
        out[r["block"] * CELL_BLOCK : (r["block"] + 1) * CELL_BLOCK] = np.minimum(255, 6 * np.log2(1 + n)).astype(np.uint8)
    return out


def _streamed(fn):
    """The form of group function that gets a group in batches; it is recognised by its annotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)

    return run


def _prefix(n: int, t: tuple[int, int]) -> int:
    """How many of a set's first shingles meet those of any partner: ``n - ceil(t n) + 1``."""
    return n - -(-t[0] * n // t[1]) + 1


def _short(n: int, t: tuple[int, int]) -> int:
    """The same for the smaller set of a pair, whose overlap is at least ``2t / (1 + t)`` of it."""
    return n - -(-2 * t[0] * n // (t[0] + t[1])) + 1


SIGN_BITS, SIGN_KEYS = 512, 12


def _sign(own: np.ndarray, prefix: np.ndarray, short: int) -> bytes:
    """What a set brings to every tile it is in, 256 bytes whatever its size: a bitmap and its smallest keys.

    The keys are the smallest of its short prefix and of the whole one.
    """
    flags = np.zeros(SIGN_BITS, dtype=bool)
    flags[(own & np.uint64(SIGN_BITS - 1)).astype(np.int64)] = True
    keys = np.zeros(2 * SIGN_KEYS, dtype=np.int64)
    for at, part in ((0, prefix[:short]), (SIGN_KEYS, prefix)):
        least = np.sort(part)[:SIGN_KEYS]
        keys[at : at + SIGN_KEYS] = np.concatenate((least, np.repeat(least[-1:], SIGN_KEYS - len(least))))
    return np.packbits(flags, bitorder="little").tobytes() + keys.tobytes()


def _bitmap(own: np.ndarray) -> bytes:
    """Four to eight bits a shingle, the same number for all sets of a size band."""
    bits = max(64, 8 << band_of(len(own))) if len(own) else 64
    flags = np.zeros(bits, dtype=bool)
    flags[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _wide(bitmap: bytes) -> bytes:
    """The bitmap of a set, folded to what a row of a crowded tile may bring."""
    if len(bitmap) <= WIDE_BYTES:
        return bitmap
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, WIDE_BYTES)).tobytes()


def signatures(texts: DataFrame, size: int, t: tuple[int, int], order: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, short, bits, sign, wide) of every row; ``short`` is how much of the prefix serves the smaller set."""

    def run(batches):
        for batch in batches:
            ids = _column(batch, "doc_id")
            for lo, hi, data, at in blocks(_column(batch, "text")):
                n, k1, k2, prefix, short, bits, sign = [], [], [], [], [], [], []
                for own in shingles(data, at, size):
                    n.append(len(own))
                    k1.append(own.sum(dtype=np.uint64))
                    k2.append(mix(own).sum(dtype=np.uint64))
                    if len(own):
                        cell = order[(own >> np.uint64(44)).astype(np.int64)]
                        prefix.append(own[np.argsort(cell, kind="stable")[: _prefix(len(own), t)]].view(np.int64))
                        short.append(_short(len(own), t))
                        sign.append(_sign(own, prefix[-1], short[-1]))
                    else:
                        prefix.append(np.zeros(0, np.int64))
                        short.append(0)
                        sign.append(b"")
                    bits.append(_bitmap(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(k1, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(k2, dtype=np.uint64).view(np.int64)),
                        list_array(prefix, pa.int64()),
                        pa.array(short, pa.int32()),
                        pa.array(bits, pa.binary()),
                        pa.array(sign, pa.binary()),
                        pa.array([_wide(b) for b in bits], pa.binary()),
                    ],
                    names=["doc_id", "n", "k1", "k2", "prefix", "short", "bits", "sign", "wide"],
                )

    return texts.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>, short int, bits binary, sign binary, wide binary")


def _words(bits: np.ndarray, length: int) -> np.ndarray:
    """Rows of a bitmap matrix folded to ``length`` bytes, as 64-bit words."""
    if bits.shape[1] > length:
        bits = np.bitwise_or.reduce(bits.reshape(len(bits), -1, length), axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)


def _may_link(na, nb, only_a, only_b, t: tuple[int, int]):
    """Whether bit counts allow the overlap that the threshold asks for.

    A bit that only one side has stands for a shingle that the other lacks, so
    the overlap is at most each size less such bits.
    """
    most = np.minimum(na - only_a, nb - only_b)
    return t[1] * most >= t[0] * (na + nb - most)


def _bounded(pairs: DataFrame, signs: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that pass the bound of their bitmaps; the longer bitmap is folded to the shorter."""
    one = signs.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    two = signs.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def run(batches):
        for batch in batches:
            na, nb = (_column(batch, c).to_numpy() for c in ("na", "nb"))
            keep = np.zeros(len(na), dtype=bool)
            for i, (x, y) in enumerate(zip(_column(batch, "ba"), _column(batch, "bb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8)[None, :], np.frombuffer(y.as_buffer(), np.uint8)[None, :]
                least = min(x.shape[1], y.shape[1])
                x, y = _words(x, least)[0], _words(y, least)[0]
                keep[i] = _may_link(na[i], nb[i], int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum()), t)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([_column(batch, c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _wide_pass(wide: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Which pairs (p, q) of rows pass the bound of their long bitmaps; rows without one pass."""
    go = np.ones(len(p), dtype=bool)
    size = np.array([len(w) if w is not None else 0 for w in wide], dtype=np.int64)
    both = np.minimum(size[p], size[q]) > 0
    for lp, lq in {*zip(size[p[both]].tolist(), size[q[both]].tolist(), strict=True)}:
        at = np.flatnonzero(both & (size[p] == lp) & (size[q] == lq))
        for some in np.array_split(at, -(-len(at) // 8192)):
            a, b = (_words(np.frombuffer(b"".join(wide[r]), np.uint8).reshape(len(some), -1), min(lp, lq)) for r in (p[some], q[some]))
            only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
            go[some] = _may_link(n[p[some]], n[q[some]], only_a, only_b, t)
    return go


def _block_pairs(rows: dict[str, np.ndarray], end: np.ndarray, t: tuple[int, int], best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of whole cells that pass the bound of their fixed bitmaps, and of the long ones in crowded tiles.

    Rows stand in order of cell, size and id, and ``end`` is where a row's cell
    ends. All pairs at one distance in this order are compared at once. The
    smaller of a pair has the key in its short prefix, the larger is at home in
    the band. With ``best`` each row keeps its likeliest larger partner only;
    otherwise a pair is left to another tile if both name a smaller shared key.
    """
    doc, n, component, part, home, short, key = (rows[c] for c in ("doc_id", "n", "component", "part", "home", "short", "key"))
    same = rows["i"] == rows["j"]
    bits = np.ascontiguousarray(rows["sign"][:, : SIGN_BITS // 8]).view(np.uint64)
    keys = np.ascontiguousarray(rows["sign"][:, SIGN_BITS // 8 :]).view(np.int64)
    # Keys below the tile's; the others are made to differ.
    mine = np.where(keys[:, :SIGN_KEYS] < key[:, None], keys[:, :SIGN_KEYS], key[:, None])
    other = np.where(keys[:, SIGN_KEYS:] < key[:, None], keys[:, SIGN_KEYS:], key[:, None] + 1)
    gap, partner = np.full(len(doc), 1 << 40), np.full(len(doc), -1)
    found = []
    x, d = np.flatnonzero(short), 0
    while True:
        d += 1
        x = x[x + d < end[x]]
        # Sizes ascend, so a row whose partner is too large has no further one.
        x = x[n[x + d] * t[0] <= n[x] * t[1]]
        if not len(x):
            break
        y = x + d
        ok = home[y] & (component[x] != component[y]) & (same[x] | (part[x] != part[y]))
        p, q = x[ok], y[ok]
        only_p = np.bitwise_count(bits[p] & ~bits[q]).sum(axis=1, dtype=np.int64)
        only_q = np.bitwise_count(bits[q] & ~bits[p]).sum(axis=1, dtype=np.int64)
        go = _may_link(n[p], n[q], only_p, only_q, t)
        p, q, off = p[go], q[go], (only_p + only_q)[go]
        # Fixed bitmaps of long sets are almost full and pass all pairs of a tile, which go with its square.
        go = _wide_pass(rows["wide"], n, p, q, t)
        p, q, off = p[go], q[go], off[go]
        if best:
            nearer = off < gap[p]
            gap[p[nearer]], partner[p[nearer]] = off[nearer], q[nearer]
        elif len(p):
            later = (mine[p][:, :, None] == other[q][:, None, :]).any(axis=(1, 2))
            found.append((p[~later], q[~later]))
    if best:
        found = [(np.flatnonzero(partner >= 0), partner[partner >= 0])]
    none = np.zeros(0, dtype=np.int64)
    p, q = np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])
    return np.minimum(doc[p], doc[q]), np.maximum(doc[p], doc[q])


def _tile_pairs(member: DataFrame, signs: DataFrame, t: tuple[int, int], best: bool = False) -> DataFrame:
    """Distinct pairs of different classes that share a tile and pass the bound, from (key, band, doc_id, pos, home, component).

    Rows of a cell arrive one after the other, so a task holds one cell, of at
    most about twice ``TILE_ROWS`` members.
    """
    size = Window.partitionBy("key", "band")
    rows = member.withColumn("members", F.count("*").over(size)).withColumn("parts", F.ceil(F.col("members") / TILE_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("other", other).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")
    rows = rows.join(signs.select("doc_id", "n", (F.col("short")).alias("kept"), "sign", "wide"), "doc_id")
    rows = rows.withColumn("wide", F.when(F.col("members") >= CROWD_ROWS, F.col("wide"))).drop("members")
    rows = rows.withColumn("short", F.col("pos") < F.col("kept")).drop("pos", "kept")
    tasks = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "n", "doc_id")
    plain = ("key", "band", "i", "j", "doc_id", "n", "component", "part", "home", "short")

    def run(batches):
        held: list[dict[str, np.ndarray]] = []

        def done(upto: int):
            """Pairs of the held rows before ``upto``, which ends a cell; the rest stays held."""
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held[:] = [{c: v[upto:] for c, v in rows.items()}] if upto < len(rows["key"]) else []
            rows = {c: v[:upto] for c, v in rows.items()}
            first = np.flatnonzero(np.concatenate(([True], np.any([rows[c][1:] != rows[c][:-1] for c in plain[:4]], axis=0))))
            size = np.diff(np.append(first, upto))
            a, b = _block_pairs(rows, np.repeat(first + size, size), t, best)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: _column(batch, c).to_numpy(zero_copy_only=False) for c in plain}
            now["sign"] = np.frombuffer(b"".join(x.as_py() for x in _column(batch, "sign")), np.uint8).reshape(batch.num_rows, -1)
            now["wide"] = _column(batch, "wide").to_numpy(zero_copy_only=False)
            before = sum(len(h["key"]) for h in held)
            turn = np.any([now[c][1:] != now[c][:-1] for c in plain[:4]], axis=0)
            last = int(np.flatnonzero(turn)[-1]) + 1 if turn.any() else 0
            if not last and held and any(now[c][0] != held[-1][c][-1] for c in plain[:4]):
                yield done(before)
                before = 0
            held.append(now)
            if last:
                yield done(before + last)
        if held:
            yield done(sum(len(h["key"]) for h in held))

    columns = [*plain[:4], "doc_id", "n", "component", "part", "home", "short", "sign", "wide"]
    return rows.select(*columns).mapInArrow(run, "a long, b long").distinct()


def _sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, s): sorted shingle arrays of the texts with these ids."""
    n = ids.count()
    chosen = F.broadcast(ids) if n <= SMALL_IDS else ids
    rows = texts.join(chosen, "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            own = _column(batch, "doc_id")
            for lo, hi, data, at in blocks(_column(batch, "text")):
                sets = [s.view(np.int64) for s in shingles(data, at, size)]
                yield pa.RecordBatch.from_arrays([own.slice(lo, hi - lo), list_array(sets, pa.int64())], names=["doc_id", "s"])

    return rows.mapInArrow(run, "doc_id long, s array<long>")


def _proven(pairs: DataFrame, texts: DataFrame, size: int, t: tuple[int, int]) -> DataFrame:
    """The pairs whose sets reach the threshold, by intersecting sorted arrays; unsigned order."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = cut_lineage(_sets(texts, ids, size))

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            sa, sb = _column(batch, "sa"), _column(batch, "sb")
            for i in range(batch.num_rows):
                x = sa[i].values.to_numpy().view(np.uint64)
                y = sb[i].values.to_numpy().view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep[i] = t[1] * both >= t[0] * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([_column(batch, c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, *, size: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Words are runs free of x20 and x09-x0D after lower-casing A-Z. A set has
    the distinct runs of ``size`` words; a text of fewer words has its whole
    sequence; one without words, or null, is empty and linked with nothing.
    Sets link when ``threshold`` (a ratio of integers) of their union is
    shared. ``component_id`` is the smallest id that links reach, itself
    included. A null id is linked with nothing and has a null component; rows
    that repeat an id are one node. Shingles are compared by 64-bit hashes.
    Other columns are ignored.
    """
    t = threshold
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signs = cut_lineage(signatures(texts, size, t, rarity(texts, size)))
    full = signs.where("doc_id IS NOT NULL AND n > 0")
    copies = full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    nodes = full.join(copies.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "k1", "k2"])

    band = lambda n: F.floor(F.log2(n.cast("double") + 0.5))
    most = F.floor(F.col("n") * t[1] / t[0])
    at = F.array_distinct(F.array(band(F.col("n")), band(most)))
    posts = nodes.select("doc_id", "n", band(F.col("n")).alias("home"), at.alias("at"), F.posexplode("prefix").alias("pos", "key"))
    posts = posts.select("key", F.explode("at").alias("band"), "home", "doc_id", "n", "pos")
    # A member of a tile: `home` is where it can be the larger of a pair.
    posts = posts.withColumn("home", F.col("home") == F.col("band"))
    whole = Window.partitionBy("key", "band")
    tiles = cut_lineage(posts.withColumn("members", F.count("*").over(whole)).where("members > 1").drop("members", "n"))
    likely = _tile_pairs(tiles.withColumn("component", F.col("doc_id")), nodes, t, best=True)
    links = cut_lineage(_proven(cut_lineage(_bounded(likely, signs, t)), texts, size, t))
    first = cut_lineage(components(links))

    member = tiles.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    member = member.withColumn("component", F.coalesce("component", "doc_id"))
    member = member.withColumns({"lo": F.min("component").over(whole), "hi": F.max("component").over(whole)}).where("lo <> hi").drop("lo", "hi")
    more = cut_lineage(_proven(cut_lineage(_bounded(cut_lineage(_tile_pairs(member, nodes, t)), signs, t)), texts, size, t))

    # Links between classes and copies, then the smallest id of each class.
    edges = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    star = full.join(copies, ["n", "k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(star)).withColumnRenamed("node", "doc_id")
    out = signs.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def prefix_length(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Shingles under which a set of ``n`` is filed."""
    return _prefix(n, threshold) if n else 0


def band_of(n: int) -> int:
    """Size band of a set."""
    return math.floor(math.log2(n + 0.5))
