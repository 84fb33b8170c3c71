"""Toxicity from a learned lexicon, matched through misspellings, with the context deciding.

The lexicon is a trie. A word's Levenshtein automaton (with swaps of
neighbouring letters) is walked together with it, so that all entries in reach
are found without trying each: one edit for entries of 5 to 7 letters, two for
longer ones (one of them a swap at most), none for shorter ones. Before that, a
word is cleared of letters written as signs and of letters said three times or
more, and single letters in a row are read as one word. Words whose letters
differ too much from those of every entry are not walked at all: that many
edits could not make up for it.

An entry is a whole word or a prefix that a family of words shares. Entries
are those that stand in rows of label 1 significantly more often than their
share (a fixed false-discovery rate). An entry matches misspelled only if what
lies around it is pure and it is strong itself: words of clean rows that would match become known
words, and as many entries stay out as it takes until further clean words
would hit few rows (as told by the words that were seen once).

Matches inside quotation marks, or near a word of reporting, are counted apart
from the others, and misspelled ones apart from exact ones. The score is a
logistic function of sums over distinct words and of the densest window of
words, none of them relative to the length of the text. Its weights are fitted
on sampled rows that a lexicon of the other half of the sample has not seen, on
copies of them with misspelled matches, and on clean rows that quote an entry.

The lexicon and the weights come from a bounded sample of labelled rows that
are not held out (``FIT_ROWS``); the scoring covers every word of every text.
"""

from __future__ import annotations

import functools
import heapq
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.kernel import _LOWER, blocks, span_hashes

FIT_ROWS = (6_000, 12_000)  # labelled rows of label 1 and 0 at most, about
FALSE_DISCOVERIES = 0.01  # share of chance finds among the entries
LEAST_ODDS = 2.0  # log-odds that an entry has at least
COVER = 8  # entries that explain a row of label 1 at most
FUZZY_LENGTH = 5  # shorter entries match exactly only
FUZZY_ODDS = 3.0  # log-odds of entries that match misspelled at least
FAR_LENGTH = 8  # entries from here on match within two edits
IMPURE = 0.002  # share of clean rows that all entries together may hit misspelled by words not yet known
STEM = (4, 10)
CONTEXT = 6  # words before a match that may report it
WINDOW = 40  # words of the densest stretch

# Letters written as signs, and words that report another's speech.
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_REPORTING = frozenset("said says say wrote writes called calling quoted quote quoting dit disait sagte sagt schrieb dijo dice escribió".split())
_PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›"}

_WORD = re.compile(r"[^\W_]+(?:[@$*]+[^\W_]+)*")
# Five single letters or more in a row, with the same kind of short gap.
_SPELT = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*·/])[^\W\d_])(?:\1[^\W\d_]){3,}(?![^\W_])")
_SAID_LONG = re.compile(r"(.)\1{2,}")
# Letters that are lowered: A-Z and the Latin-1 capitals.
_CAPITALS = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7}


def held_out(doc_id: Column) -> Column:
    """Whether the remainder of the CRC-32 of the id's text by 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# ---------------------------------------------------------------- automaton and trie


def edits(length: int) -> int:
    """Edits within which an entry of that many letters matches."""
    return 0 if length < FUZZY_LENGTH else 1 if length < FAR_LENGTH else 2


class Automaton:
    """The universal Levenshtein automaton for ``most`` edits, a swap of neighbours being one edit.

    A state is a set of (letters of the word used, edits, half a swap), the
    first counted from the state's base. What a letter does to a state depends
    only on where it stands in the next ``2 * most + 2`` letters of the word,
    so steps are remembered for all words together.
    """

    def __init__(self, most: int):
        self.most, self.reach = most, 2 * most + 2
        self.known: dict[tuple, tuple[tuple, int]] = {}

    START = ((0, 0, False, False),)

    def step(self, state: tuple, bits: int, left: int) -> tuple[tuple, int]:
        """The state after a letter and by how much its base moves on; ``bits`` says where the letter stands, ``left`` how much is left."""
        key = (state, bits, left)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._step(state, bits, left)
        return found

    def _step(self, state: tuple, bits: int, left: int) -> tuple[tuple, int]:
        after: set[tuple[int, int, bool, bool]] = set()
        for i, e, half, swapped in state:
            own = bits >> i
            if half:
                # The letter before was the next but one; this must be the one passed over.
                if own & 1:
                    after.add((i + 2, e, False, True))
                continue
            if own & 1 and i < left:
                after.add((i + 1, e, False, swapped))
            if e < self.most:
                after.add((i, e + 1, False, swapped))
                if i < left:
                    after.add((i + 1, e + 1, False, swapped))
                for j in range(1, self.most - e + 1):
                    if i + j < left and own >> j & 1:
                        after.add((i + j + 1, e + j, False, swapped))
                if not swapped and i + 1 < left and own & 2:
                    after.add((i, e + 1, True, True))
        if not after:
            return (), 0
        # What another position reaches with fewer edits adds nothing.
        kept = [
            p for p in after
            if not any(q != p and not q[2] and not p[2] and q[3] <= p[3] and q[1] < p[1] and abs(q[0] - p[0]) <= p[1] - q[1] for q in after)
        ]
        base = min(p[0] for p in kept)
        return tuple(sorted((i - base, e, h, s) for i, e, h, s in kept)), base


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: str | None = None
    stem: str | None = None
    under: int = 0


def _trie(words, stems) -> Node:
    root = Node()
    for entries, name in ((words, "word"), (stems, "stem")):
        for entry in sorted(entries):
            node = root
            for c in entry:
                node = node.next.setdefault(c, Node())
            setattr(node, name, entry)
    return root


def _forms(word: str) -> list[str]:
    """The word with signs read as letters, and that without letters said three times or more."""
    plain = word if word.isalpha() else word.translate(_SIGNS)
    return [plain, _SAID_LONG.sub(r"\1", plain)] if _SAID_LONG.search(plain) else [plain]


def _mask(word: str) -> int:
    """The letters a-z of a word as bits."""
    out = 0
    for c in word:
        if "a" <= c <= "z":
            out |= 1 << (ord(c) - 97)
    return out


class Lexicon:
    """Entries with weights: whole ``words`` and ``stems`` as prefixes.

    ``fuzzy`` names the entries that match misspelled, a stem with ``*`` behind
    it; if it is not given, all words do and no stem. Stems match within one
    edit. ``benign`` holds words that never match misspelled.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: set[str] | None = None, benign: frozenset[str] | set[str] = frozenset()):
        self.words, self.stems, self.benign = words, stems, benign
        self.fuzzy = {w for w in (words if fuzzy is None else fuzzy) if len(w.rstrip("*")) >= FUZZY_LENGTH}
        self.root = _trie(words, stems)
        whole = sorted(w for w in self.fuzzy if not w.endswith("*"))
        parts = sorted(w[:-1] for w in self.fuzzy if w.endswith("*"))
        self.near_root = _trie(whole, parts)
        self.near_edits = max((edits(len(w)) for w in whole), default=1)
        self.automata = {k: Automaton(k) for k in (1, 2)}
        # Of each fuzzy entry: its letters, its pairs of letters and how long a word in reach can be. A bit each in `under` of the trie's nodes.
        self.masks = np.array([_mask(w) for w in [*whole, *parts]], dtype=np.uint32)
        self.pairs = np.array([_pair_mask(w) for w in [*whole, *parts]], dtype=np.uint64)
        self.edits = np.array([edits(len(w)) for w in whole] + [1] * len(parts), dtype=np.int64)
        self.lengths = np.array([len(w) for w in [*whole, *parts]], dtype=np.int64)
        self.n_whole = len(whole)
        for k, w in enumerate([*whole, *parts]):
            node = self.near_root
            node.under |= 1 << k
            for c in w:
                node = node.next[c]
                node.under |= 1 << k
        self.known: dict[str, tuple[str, float, int] | None] = {}
        self.filter = Filter()

    def maybe_near(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        """Of words as byte spans: the fuzzy entries (as bits) that their letters and lengths leave in reach.

        An edit changes two of a word's letters and three of its pairs of
        neighbours at most (two, but for a swap).
        """
        if not len(starts) or not len(self.masks):
            return [0] * len(starts)
        lead = np.flatnonzero((low & 0xC0) != 0x80)
        n = np.searchsorted(lead, ends) - np.searchsorted(lead, starts)
        same = np.zeros(len(low) + 1, dtype=np.int64)
        np.cumsum(np.concatenate(([False], (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]), [False]))[: len(low)], out=same[1:])
        said_long = same[ends] > same[starts]
        letters = _spans_or(_BITS[low], starts, ends)
        pairs = _spans_or(_pair_bits(low), starts, np.maximum(starts + 1, ends - 1))
        most, whole = self.edits, self.n_whole
        out: list[int] = []
        for lo in range(0, len(starts), 8192):
            m, p, k, run = letters[lo : lo + 8192, None], pairs[lo : lo + 8192, None], n[lo : lo + 8192, None], said_long[lo : lo + 8192, None]
            lost = np.bitwise_count(self.masks & ~m)
            # A swap costs three pairs and no letter.
            fits = (k >= self.lengths - most) & (lost <= most) & (np.bitwise_count(self.pairs & ~p) <= 2 * most + (lost < most))
            own, short = fits[:, :whole], most[:whole]
            more = (np.bitwise_count(m & ~self.masks[:whole]) <= short) & (np.bitwise_count(p & ~self.pairs[:whole]) <= 2 * short + 1)
            own &= (run | ((k <= self.lengths[:whole] + short) & more))
            bits = np.packbits(fits, axis=1, bitorder="little")
            some = fits.any(axis=1)
            out += [int.from_bytes(row.tobytes(), "little") if s else 0 for row, s in zip(bits, some.tolist(), strict=True)]
        return out

    def maybe_near_words(self, words: list[str]) -> list[int]:
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) + 1 for w in raw], dtype=np.int64) - 1 if raw else np.zeros(0, np.int64)
        return self.maybe_near(np.frombuffer(b" ".join(raw), dtype=np.uint8), ends - np.array([len(w) for w in raw], dtype=np.int64), ends)

    def exact(self, word: str) -> tuple[str, float, int] | None:
        """The word itself, or the heaviest stem it starts with."""
        node, best = self.root, None
        for c in word:
            node = node.next.get(c)
            if node is None:
                break
            if node.stem is not None and (best is None or self.stems[node.stem] > self.stems[best]):
                best = node.stem
        else:
            if node.word is not None:
                return node.word, self.words[node.word], 0
        return None if best is None else (best + "*", self.stems[best], 0)

    def inside(self, word: str) -> list[tuple[int, int]]:
        """Where whole entries of fuzzy length stand in a word, from left to right, the longest first, without overlap."""
        out, i = [], 0
        while i < len(word):
            node, end = self.root, 0
            for j in range(i, len(word)):
                node = node.next.get(word[j])
                if node is None:
                    break
                if node.word is not None and len(node.word) >= FUZZY_LENGTH:
                    end = j + 1
            out += [(i, end)] if end else []
            i = end or i + 1
        return out

    def near(self, word: str, among: int = -1) -> tuple[str, float, int] | None:
        """The nearest fuzzy entry in reach, of equally near ones the heaviest."""
        best = min(self.around(word, among), default=None)
        return None if best is None else (best[2], -best[1], max(1, best[0]))

    def around(self, word: str, among: int = -1) -> list[tuple[int, float, str]]:
        """(edits, minus weight, entry) of all fuzzy entries in reach, by walking trie and automaton together.

        Branches without an entry of ``among`` (bits) are not entered.
        """
        most = 2 if self.near_edits > 1 and len(word) >= FAR_LENGTH - 2 else 1
        auto = self.automata[most]
        n, reach = len(word), auto.reach
        where: dict[str, int] = {}
        for k, c in enumerate(word):
            where[c] = where.get(c, 0) | 1 << k
        window = (1 << reach) - 1
        found: list[tuple[int, float, str]] = []
        open_: list[tuple[Node, int, tuple]] = [(self.near_root, 0, Automaton.START)]
        while open_:
            node, base, state = open_.pop()
            if node.word is not None:
                far = min((e + n - base - i for i, e, half, _ in state if not half), default=99)
                if far <= edits(len(node.word)):
                    found.append((far, -self.words[node.word], node.word))
            if node.stem is not None:
                far = min((e for _, e, half, _ in state if not half), default=99)
                if far <= 1:
                    found.append((far, -self.stems[node.stem], node.stem + "*"))
            left = min(n - base, reach)
            for c, after in node.next.items():
                if not after.under & among:
                    continue
                state2, moved = auto.step(state, (where.get(c, 0) >> base) & window, left)
                if state2:
                    open_.append((after, base + moved, state2))
        return found

    def match(self, word: str, near: int = -1) -> tuple[str, float, int] | None:
        """(entry, weight, distance) of a lower-case word; each distinct word is looked up once while it is remembered.

        ``near`` names the entries that could be in reach (``maybe_near``).
        """
        if word in self.known:
            return self.known[word]
        out = self.exact(word)
        if out is None and word not in self.benign:
            forms = _forms(word)
            for w in forms:
                got = self.exact(w) if w != word else None
                out = out or (got and (got[0], got[1], 1))
            if out is None and near and self.fuzzy:
                for w in forms:
                    out = out or self.near(w, near)
        if len(self.known) >= 200_000:
            self.known.clear()
        self.known[word] = out
        return out


@dataclass
class Model:
    """Words, stems, the entries that match misspelled, words that never do, and the weights of ``FEATURES``."""

    words: dict[str, float]
    stems: dict[str, float]
    fuzzy: set[str]
    benign: set[str]
    weights: list[float]

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems, self.fuzzy, self.benign)


# The bit of a byte in a word's letters: letters and the signs that stand for them.
_BITS = np.zeros(256, dtype=np.uint32)
for _c in range(97, 123):
    _BITS[_c] = 1 << (_c - 97)
for _c, _to in _SIGNS.items():
    _BITS[_c] = 1 << (ord(_to) - 97)


class Filter:
    """Finds the words of many texts that match, on their bytes: each distinct word is looked up once while it is remembered."""

    def __init__(self):
        self.known: dict[int, bool] = {}
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def _new(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, lexicon: Lexicon) -> list[bool]:
        """Whether words that were not seen before match."""
        if self.tables is None:
            raw = [w.encode() for w in sorted(lexicon.words)]
            data = np.frombuffer(b"".join(raw) + b" ", dtype=np.uint8)
            ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
            own = span_hashes(data, ends - np.array([len(w) for w in raw], dtype=np.int64), ends) if raw else np.zeros(0, np.uint64)
            heads = np.frombuffer(b"".join(s.encode()[:4] for s in sorted(lexicon.stems)), dtype=">u4")
            self.tables = own, np.unique(heads.astype(np.int64))
        near = lexicon.maybe_near(low, begin, end)
        four = np.append(low, np.zeros(4, np.uint8)).astype(np.int64)
        head = four[begin] << 24 | four[begin + 1] << 16 | four[begin + 2] << 8 | four[begin + 3]
        odd = np.cumsum(np.concatenate(([0], _ODD_BYTES[low])))
        same = np.concatenate(([False], (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]), [False]))[: len(low)]
        same = np.cumsum(np.concatenate(([0], same)))
        # Words that are no entry, start like no stem, have no sign and no letter three times go on only if an entry is near.
        ask = np.isin(hashes, self.tables[0]) | np.isin(head, self.tables[1]) | (odd[end] > odd[begin]) | (same[end] > same[begin])
        raw = low.tobytes()
        return [(n != 0 or e) and lexicon.match(raw[a:b].decode("utf-8", "replace"), n) is not None for a, b, n, e in zip(begin.tolist(), end.tolist(), near, ask.tolist(), strict=True)]

    def blocks(self, column: pa.Array, lexicon: Lexicon):
        """(first row, rows, lowered bytes, word starts, word ends, hits, rows to read in full) of runs of texts."""
        for lo, hi, data, at in blocks(column):
            low = _lowered(data)
            starts, ends = _tokens(low, at)
            full = np.zeros(hi - lo, dtype=bool)
            if not len(starts):
                continue
            words, first, which = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
            hashes = words.tolist()
            hit = [self.known.get(h) for h in hashes]
            new = [k for k, h in enumerate(hit) if h is None]
            if new:
                for k, h in zip(new, self._new(low, starts[first[new]], ends[first[new]], words[new], lexicon), strict=True):
                    hit[k] = self.known[hashes[k]] = h
            if len(self.known) >= 500_000:
                self.known.clear()
            row = np.searchsorted(at, starts, side="right") - 1
            hits = np.array(hit, dtype=bool)[which]
            # Five words of one letter in a row, each right behind the other, may be one.
            lead = np.cumsum(np.concatenate(([0], (low & 0xC0) != 0x80)))
            single = lead[ends] - lead[starts] == 1
            step = np.concatenate(([False], single[1:] & single[:-1] & (lead[starts[1:]] - lead[ends[:-1]] == 1) & (row[1:] == row[:-1])))
            run = step.copy()
            for _ in range(3):
                run = step & np.concatenate(([False], run[:-1]))
            full[row[run]] = True
            # Context counts only where there are matches.
            some = np.zeros(hi - lo, dtype=bool)
            some[row[hits]] = True
            if some.any():
                marks = np.flatnonzero((low == 0x22) | ((low == 0xE2) & (np.append(low[1:], 0) == 0x80)) | ((low == 0xC2) & np.isin(np.append(low[1:], 0), (0xAB, 0xBB))))
                full[np.searchsorted(at, marks, side="right") - 1] = True
                full[row[np.isin(words, _reporting_hashes())[which]]] = True
                full &= some | np.isin(np.arange(hi - lo), row[run])
            yield lo, at, low, starts, ends, row, hits, full

    def texts(self, column: pa.Array, lexicon: Lexicon) -> np.ndarray:
        """Whether each text has a word that matches, or single letters in a row that may be one."""
        out = np.zeros(len(column), dtype=bool)
        for lo, _, _, _, _, row, hits, full in self.blocks(column, lexicon):
            out[lo + row[hits]] = True
            out[lo + np.flatnonzero(full)] = True
        return out


@functools.lru_cache(maxsize=1)
def _reporting_hashes() -> np.ndarray:
    raw = [w.encode() for w in sorted(_REPORTING)]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - np.array([len(w) for w in raw], dtype=np.int64), ends)


# Bytes of signs and digits that may stand for letters.
_ODD_BYTES = np.zeros(256, dtype=np.int64)
_ODD_BYTES[[*_SIGNS, *range(48, 58), 42]] = 1


def _spans_or(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bits of all bytes of each span; spans are not empty and in any order."""
    order = np.argsort(starts)
    flat = np.empty(2 * len(starts), dtype=np.int64)
    flat[0::2], flat[1::2] = starts[order], ends[order]
    out = np.empty(len(starts), dtype=bits.dtype)
    out[order] = np.bitwise_or.reduceat(np.append(bits, bits.dtype.type(0)), flat)[0::2]
    return out


# The letters that bytes stand for, 0 if none.
_LETTERS = np.zeros(256, dtype=np.uint64)
_LETTERS[97:123] = np.arange(1, 27, dtype=np.uint64)
for _c, _to in _SIGNS.items():
    _LETTERS[_c] = ord(_to) - 96


def _pair_bits(low: np.ndarray) -> np.ndarray:
    """A bit of 64 for each pair of neighbouring letters a-z, where it begins."""
    a = _LETTERS[low]
    b = np.append(a[1:], np.uint64(0))
    return np.where((a > 0) & (b > 0), np.uint64(1) << ((a * np.uint64(29) + b) % np.uint64(64)), np.uint64(0))


def _pair_mask(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(np.bitwise_or.reduce(_pair_bits(raw)))


_SOLID = np.zeros(256, dtype=bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


@functools.lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """Of each code point, whether it is a letter or digit of ``_WORD``."""
    out = np.zeros(0x110000, dtype=bool)
    for m in re.finditer(r"[^\W_]+", "".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def _lowered(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[capital] += 32
    return low


def _tokens(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that ``_WORD`` finds in each text."""
    solid = _SOLID[low]
    wide = np.flatnonzero(low >= 128)
    if len(wide):
        lead = (low[wide] & 0xC0) != 0x80
        head = wide[lead]
        tail = [low[np.minimum(head + k, len(low) - 1)].astype(np.int64) & 63 for k in (1, 2, 3)]
        c = low[head].astype(np.int64)
        point = np.where(c < 0xE0, (c & 31) << 6 | tail[0], np.where(c < 0xF0, (c & 15) << 12 | tail[0] << 6 | tail[1], (c & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        if len(head):
            solid[wide] = _word_points()[np.minimum(point, 0x10FFFF)][np.maximum(np.cumsum(lead) - 1, 0)]
    # Runs of signs that have a letter before and behind them, in the same text.
    sign = np.flatnonzero((low == 64) | (low == 36) | (low == 42))
    if len(sign):
        cut = np.flatnonzero((np.diff(sign) > 1) | np.isin(sign[1:], at)) + 1
        first, last = sign[np.concatenate(([0], cut))], sign[np.concatenate((cut - 1, [len(sign) - 1]))]
        good = (first > 0) & (last + 1 < len(low))
        first, last = first[good], last[good]
        good = solid[first - 1] & solid[last + 1] & ~np.isin(first, at) & ~np.isin(last + 1, at)
        for a, b in zip(first[good].tolist(), last[good].tolist(), strict=True):
            solid[a : b + 1] = True
    begin = np.zeros(len(low) + 1, dtype=bool)
    begin[:-1] = solid
    begin[1:-1] &= ~solid[:-1]
    stop = np.zeros(len(low) + 1, dtype=bool)
    stop[1:] = solid
    stop[1:-1] &= ~solid[1:]
    # Texts stand next to each other: a run ends with its text.
    for x in at[1:-1].tolist():
        if 0 < x < len(low) and solid[x - 1] and solid[x]:
            begin[x] = stop[x] = True
    return np.flatnonzero(begin), np.flatnonzero(stop)


# ---------------------------------------------------------------- features and score

FEATURES = ("bias", "strong", "weak", "misspelled", "densest", "quoted")
GROWING = 5  # so many features, the bias left out, only ever speak for label 1
SURE = 4.0  # log-odds from which a word counts as strong


@dataclass
class Match:
    start: int
    end: int
    entry: str
    distance: int
    quoted: bool
    weight: float
    word: str
    place: int  # number of the word in its text


def matches(text: str, lexicon: Lexicon) -> list[Match]:
    """Each match, in order; code points."""
    lower = text.translate(_CAPITALS)
    spans, known = _quoted(text), lexicon.known
    said = -(10**9)
    out: list[Match] = []
    spelt = [m for m in _SPELT.finditer(lower)]
    at = n = s = 0
    for m in _WORD.finditer(lower):
        while s < len(spelt) and spelt[s].end() <= m.start():
            s += 1
        if s < len(spelt) and spelt[s].start() <= m.start():
            # Single letters in a row are one word; where it begins it is looked up, what follows belongs to it.
            if spelt[s].start() != m.start():
                continue
            begin, end = spelt[s].span()
            w = "".join(c for c in spelt[s][0][::2])
        else:
            (begin, end), w = m.span(), m[0]
        n += 1
        if w in _REPORTING:
            said = n
        hit = known[w] if w in known else lexicon.match(w)
        apart = end != m.end()
        hits = [(begin, end, w, hit)] if hit else []
        if apart and not hit:
            # Several words run together: the entries inside, two characters a letter.
            hits = [(begin + 2 * i, begin + 2 * j - 1, w[i:j], lexicon.exact(w[i:j])) for i, j in lexicon.inside(w)]
        for begin, end, w, (entry, weight, distance) in hits:  # noqa: B020
            while at < len(spans) and spans[at][1] <= begin:
                at += 1
            inside = at < len(spans) and spans[at][0] < begin
            out.append(Match(begin, end, entry, max(int(apart), distance), inside or n - said <= CONTEXT, weight, w, n))
    return out


def _quoted(text: str) -> list[tuple[int, int]]:
    """Stretches between a pair of quotation marks on one line: the first at the start of a word, the other behind one, 200 code points at most."""
    out, begun, closing = [], None, ""
    for m in re.finditer(r"[\"“”„«»‹›\n]", text):
        at, c = m.start(), m[0]
        if c == "\n":
            begun = None
        elif begun is not None and c in closing and at > begun + 1 and not text[at - 1].isspace():
            if at - begun <= 200:
                out.append((begun, at))
            begun = None
        elif c in _PAIRS and (at == 0 or not text[at - 1].isalnum()) and at + 1 < len(text) and not text[at + 1].isspace():
            begun, closing = at, _PAIRS[c]
    return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Sums are over distinct words; a longer text does not make less of them."""
    return _features(matches(text, lexicon))


def _features(found: list[Match]) -> list[float]:
    if not found:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    kinds: list[dict[str, float]] = [{}, {}, {}, {}]
    for m in found:
        kinds[3 if m.quoted else 2 if m.distance else 0 if m.weight >= SURE else 1][m.word] = m.weight
    places = [m.place for m in found if not m.quoted]
    most = lo = 0
    for hi, p in enumerate(places):
        while p - places[lo] > WINDOW:
            lo += 1
        most = max(most, hi - lo + 1)
    strong, weak, misspelt, quoted = (math.log1p(sum(k.values())) for k in kinds)
    return [1.0, strong, weak, misspelt, math.log1p(most), quoted]


def all_features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Features of every text of a column.

    Texts with quotation marks, words of reporting or single letters in a row
    beside their matches are read in full; of others the matching words are enough.
    """
    out = np.zeros((len(column), len(FEATURES)))
    out[:, 0] = 1.0
    for lo, at, low, starts, ends, row, hits, full in lexicon.filter.blocks(column, lexicon):
        for i in np.flatnonzero(full).tolist():
            out[lo + i] = features(column[lo + i].as_py(), lexicon)
        some = np.flatnonzero(hits & ~full[row])
        if not len(some):
            continue
        raw, first = low.tobytes(), np.searchsorted(starts, at)
        found: dict[int, list[Match]] = {}
        for k, a, b, i, n in zip(some.tolist(), starts[some].tolist(), ends[some].tolist(), row[some].tolist(), first[row[some]].tolist(), strict=True):
            w = raw[a:b].decode()
            entry, weight, distance = lexicon.match(w)
            found.setdefault(i, []).append(Match(a, b, entry, distance, False, weight, w, k - n))
        for i, own in found.items():
            out[lo + i] = _features(own)
    return out


def _newton(x: np.ndarray, y: np.ndarray, g: np.ndarray, ridge: float = 0.02, rounds: int = 80) -> np.ndarray:
    """Logistic regression of rows that count ``g`` each, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (g * (p - y)) + ridge * w
        bend = (x * (g * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _solved(x: np.ndarray, y: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Weights of which those of matches are not negative: features that would be are left out one after the other."""
    use = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[use] = _newton(x[:, use], y, g)
        worst = min(range(1, GROWING), key=lambda k: w[k])
        if w[worst] >= 0:
            return w
        use.remove(worst)


# ---------------------------------------------------------------- learning


def _training(docs: DataFrame, labels: DataFrame, most: tuple[int, int]) -> DataFrame:
    """(text, y, fold) of about ``most`` labelled rows a label, chosen by a hash of the id, never held-out ones.

    Equal texts of one label are one row and in one fold of two.
    """
    y = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    have = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, min(1.0, most[0] / max(1, have.get(1, 0)))).otherwise(min(1.0, most[1] / max(1, have.get(0, 0))))
    # About `most` ids, a fixed number.
    chosen = F.broadcast(y.where(part < share))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(chosen, "doc_id").select("text", "y", F.sha2("text", 256).alias("_t")).dropDuplicates(["_t", "y"])
    return rows.select("text", "y", F.pmod(F.xxhash64("_t"), F.lit(2)).cast("int").alias("fold"))


def _chance(n1: int, n0: int, share: float) -> float:
    """Log probability that of ``n1 + n0`` rows at least ``n1`` have label 1 when a ``share`` of all rows has it."""
    n = n1 + n0
    top = math.lgamma(n + 1)
    terms = [top - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(n1, min(n, n1 + 400) + 1)]
    most = max(terms)
    return most + math.log(sum(math.exp(t - most) for t in terms))


def _significant(rows: list[tuple[str, int, int]], tried: int, share: float) -> dict[str, tuple[int, int]]:
    """Candidates that pass at the false-discovery rate among ``tried`` ones (Benjamini and Hochberg's step-up rule)."""
    ranked = sorted((_chance(n1, n0, share), w, n1, n0) for w, n1, n0 in rows)
    last = 0
    for k, (p, *_) in enumerate(ranked, 1):
        if p <= math.log(FALSE_DISCOVERIES * k / max(1, tried)):
            last = k
    return {w: (n1, n0) for _, w, n1, n0 in ranked[:last]}


def _cover(rows: list[set[str]], weight: dict[str, float], depth: int = COVER) -> set[str]:
    """One after the other, the entry that explains most (rows by weight) of what has fewer than ``depth`` entries yet."""
    holds: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        for e in r:
            holds.setdefault(e, []).append(k)
    have = [0] * len(rows)
    chosen: set[str] = set()
    heap = [(-len(ks) * weight[e], e.endswith("*"), e) for e, ks in holds.items()]
    heapq.heapify(heap)
    while heap:
        gain, star, e = heapq.heappop(heap)
        # Gains only fall, so one that is still the largest after it was counted again is the largest.
        now = -sum(have[k] < depth for k in holds[e]) * weight[e]
        if now == 0:
            continue
        if now > gain:
            heapq.heappush(heap, (now, star, e))
            continue
        chosen.add(e)
        for k in holds[e]:
            have[k] += 1
    return chosen


def _prefixes(word: str) -> list[str]:
    return [word[:k] for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1)]


def _misspelt(text: str, found: list[Match], rng: random.Random) -> str:
    """The text with one edit in each match of fuzzy length."""
    out, at = [], 0
    for m in found:
        w = text[m.start : m.end]
        if len(w) >= FUZZY_LENGTH:
            k, c = rng.randrange(1, len(w) - 1), rng.choice("aeinorst")
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k] * 3 + w[k + 1 :]])
        out += [text[at : m.start], w]
        at = m.end
    return "".join(out) + text[at:]


def learn(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = FIT_ROWS) -> Model:
    """Entries with their log-odds and the weights of ``FEATURES``.

    Words and stems are counted in tasks, over distinct words of each sampled
    text. Without rows of both labels the model knows no entry and every score
    is that of the labels' mean.
    """
    sample = _training(docs, labels, most).persist()
    try:
        return _learned(sample)
    finally:
        sample.unpersist()


@dataclass
class Entries:
    """Candidates of a part of the sample, with their log-odds."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def weights(self) -> dict[str, float]:
        return {**self.words, **{s + "*": o for s, o in self.stems.items()}}

    def only(self, chosen: set[str]) -> Entries:
        return Entries({w: o for w, o in self.words.items() if w in chosen}, {s: o for s, o in self.stems.items() if s + "*" in chosen})


def _candidates(rows: list[tuple[str, int, int]], n0: int, n1: int) -> Entries:
    """Significant words (marked ``$``) and stems of families among (name, rows of label 0, rows of label 1)."""
    rows = [r for r in rows if r[2] >= 2]
    if not n0 or not n1:
        return Entries()
    odds = {w: math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1)) for w, k0, k1 in rows}
    # What stands in rows of label 0 only was never a candidate.
    good = _significant([(w, k1, k0) for w, k0, k1 in rows if odds[w] >= LEAST_ODDS], len(rows), n1 / (n0 + n1))
    out = Entries({w[:-1]: odds[w] for w in good if w.endswith("$")})
    leading: dict[str, int] = {}
    for w in out.words:
        for p in [*_prefixes(w), w]:
            leading[p] = max(leading.get(p, 0), good[w + "$"][0])
    longer: dict[str, list[tuple[int, int]]] = {}
    for w, k in good.items():
        if not w.endswith("$"):
            longer.setdefault(w[:-1], []).append(k)
    for w, (k1, k0) in good.items():
        # A stem stands for a family: no single word has most of its rows, and no longer stem says as much.
        if not w.endswith("$") and k1 >= 1.5 * leading.get(w, 0) and not any(a >= 0.95 * k1 and b <= k0 for a, b in longer.get(w, ())):
            out.stems[w] = odds[w]
    return out


def _learned(sample: DataFrame) -> Model:
    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                found = {w for w in _WORD.findall(text.translate(_CAPITALS)) if len(w) <= 40}
                found = {w + "$" for w in found} | {p for w in found for p in _prefixes(w)}
                for w in found:
                    seen.setdefault(w, [0, 0, 0, 0])[2 * fold + (1 if y else 0)] += 1
        rows = [(w, *n) for w, n in seen.items()]
        for lo in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[lo : lo + 20_000], strict=True)], ["w", "a0", "a1", "b0", "b1"])

    total = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    n0, n1 = (sum(n for (_, y), n in total.items() if y == k) for k in (0, 1))
    if not n0 or not n1:
        mean = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.1
        return Model({}, {}, set(), set(), [math.log(mean / (1 - mean))] + [0.0] * (len(FEATURES) - 1))
    counts = sample.mapInArrow(count, "w string, a0 long, a1 long, b0 long, b1 long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])
    # Entries come from rows of label 1; the sample's size bounds how many words reach the driver.
    rows = [tuple(r) for r in counts.where("a1 + b1 >= 2").collect()]
    parts = [
        _candidates([(w, a0, a1) for w, a0, a1, _, _ in rows], total.get((0, 0), 0), total.get((0, 1), 0)),
        _candidates([(w, b0, b1) for w, _, _, b0, b1 in rows], total.get((1, 0), 0), total.get((1, 1), 0)),
        _candidates([(w, a0 + b0, a1 + b1) for w, a0, a1, b0, b1 in rows], n0, n1),
    ]
    known = set().union(*(p.weights() for p in parts))

    def present(batches):
        for batch in batches:
            rows = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                found = set(_WORD.findall(text.translate(_CAPITALS)))
                rows.append({"e": sorted((found | {p + "*" for w in found for p in [*_prefixes(w), w]}) & known), "fold": fold})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("e", pa.list_(pa.string())), ("fold", pa.int64())]))

    # Of entries that stand in the same rows (words of a text with many near copies), only those that explain further rows stay.
    lists = sorted({(r["fold"], tuple(r["e"])) for r in sample.where("y = 1").mapInArrow(present, "e array<string>, fold long").collect()})
    for k, part in enumerate(parts):
        own = part.weights()
        parts[k] = part.only(_cover([set(e) & own.keys() for fold, e in lists if k in (fold, 2)], own))

    every = Entries()
    for part in parts:
        every.words.update(part.words)
        every.stems.update(part.stems)
    fuzzy, benign = _pure(sample, every, n0)
    quotable = [sorted(p.words, key=lambda w: (-p.words[w], w))[:200] for p in parts]

    def measured(batches):
        # Each row is measured with the lexicon of the other fold.
        lexica = [Lexicon(parts[k].words, parts[k].stems, fuzzy & parts[k].weights().keys(), benign[k]) for k in (1, 0)]
        for batch in batches:
            for fold, lexicon in enumerate(lexica):
                cut = batch.filter(pa.compute.equal(batch.column("fold"), fold))
                x, y, g = [], [], []
                entries = quotable[1 - fold]
                for text, own, plain in zip(cut.column("text").to_pylist(), cut.column("y").to_pylist(), all_features(cut.column("text"), lexicon).tolist(), strict=True):
                    x.append(plain)
                    y.append(own)
                    g.append(1.0)
                    rng = random.Random(len(text) * 1_000_003 + sum(map(ord, text[:200])))
                    if own and plain[1] + plain[2] > 0:
                        found = matches(text, lexicon)
                        if any(m.distance == 0 and m.entry in fuzzy for m in found):
                            x.append(features(_misspelt(text, found, rng), lexicon))
                            y.append(own)
                            g.append(0.5)
                    elif not own and entries and rng.random() < 0.2:
                        # A clean text that reports an insult.
                        x.append(features(f'{text}\n"{rng.choice(entries)} {rng.choice(entries)}", said the other.', lexicon))
                        y.append(own)
                        g.append(0.5)
                yield pa.RecordBatch.from_pydict({"x": x, "y": y, "g": g}, schema=pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int64()), ("g", pa.float64())]))

    fit = sorted((tuple(r["x"]), r["y"], r["g"]) for r in sample.mapInArrow(measured, "x array<double>, y long, g double").collect())
    x, y, g = np.array([r[0] for r in fit]), np.array([r[1] for r in fit], dtype=float), np.array([r[2] for r in fit])
    last = parts[2]
    return Model(last.words, last.stems, fuzzy & last.weights().keys(), benign[2], [float(v) for v in _solved(x, y, g)])


def _pure(sample: DataFrame, entries: Entries, n0: int) -> tuple[set[str], list[set[str]]]:
    """The entries that match misspelled, and the words of clean rows (of fold 0, 1 and both) that lie around any entry.

    The words that clean rows have once tell how often a new row has one that
    was never seen (Good and Turing's estimate); entries are taken while that
    stays within ``IMPURE`` of the rows for all of them together.
    """
    words, stems = entries.words, entries.stems
    able = {e for e, o in entries.weights().items() if o >= FUZZY_ODDS and len(e.rstrip("*")) >= FUZZY_LENGTH and e.rstrip("*").isalpha()}

    def hits(batches):
        lexicon = Lexicon(words, stems, able)
        reach: dict[str, list[str]] = {}
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                own = set(_WORD.findall(text.translate(_CAPITALS)))
                new = [w for w in own if w not in reach]
                for w, n in zip(new, lexicon.maybe_near_words(new), strict=True):
                    reach[w] = sorted({e for form in _forms(w) for _, _, e in lexicon.around(form, n) if e != w}) if n else []
                for w in own:
                    if reach[w]:
                        found[w, fold] = found.get((w, fold), 0) + 1
            rows = [{"w": w, "fold": fold, "n": n, "e": reach[w]} for (w, fold), n in found.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("w", pa.string()), ("fold", pa.int64()), ("n", pa.int64()), ("e", pa.list_(pa.string()))]))

    found = sample.where("y = 0").select("text", "fold").mapInArrow(hits, "w string, fold long, n long, e array<string>")
    rows = found.groupBy("w", "fold").agg(F.sum("n").alias("n"), F.any_value("e").alias("e")).collect()
    benign = [{r["w"] for r in rows if k in (r["fold"], 2)} for k in range(3)]
    times: dict[str, int] = {}
    for r in rows:
        times[r["w"]] = times.get(r["w"], 0) + r["n"]
    once: dict[str, set[str]] = {}
    for r in rows:
        for e in r["e"] if times[r["w"]] == 1 else ():
            once.setdefault(e, set()).add(r["w"])
    weight, out, spent = entries.weights(), set(), set()
    for e in sorted(able, key=lambda e: (len(once.get(e, ())), -weight[e], e)):
        more = spent | once.get(e, set())
        if len(more) <= max(len(spent), IMPURE * n0):
            spent = more
            out.add(e)
    return out, benign


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, score and, if asked for, spans) of every row; a null text is empty.

    ``spans`` reads ``entry:start:end:distance:quoted`` joined by commas.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = np.array(model.weights)

    def run(batches):
        lexicon = model.lexicon()
        for batch in batches:
            x = all_features(batch.column("text"), lexicon)
            out = {"doc_id": batch.column("doc_id"), "score": pa.array(_logistic(x @ w))}
            if spans:
                found = [matches(t, lexicon) for t in batch.column("text").to_pylist()]
                out["spans"] = pa.array([",".join(f"{m.entry}:{m.start}:{m.end}:{m.distance}:{int(m.quoted)}" for m in ms) for ms in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return texts.mapInArrow(run, "doc_id long, score double" + ", spans string" * spans)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, spans: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` with a model learned from ``labels``.

    Rows that repeat an id are scored each; a null id is not held out. Other
    columns play no part.
    """
    got = score(docs, learn(docs, labels), spans)
    return got.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["spans"] if spans else [])
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text among their columns) that score below the threshold, as they are."""
    model = learn(docs, labels)
    w = np.array(model.weights)

    def run(batches):
        lexicon = model.lexicon()
        for batch in batches:
            x = all_features(batch.column(batch.schema.get_field_index("text")), lexicon)
            yield batch.filter(pa.array(_logistic(x @ w) < threshold))

    return docs.mapInArrow(run, docs.schema)
