"""Personal data by a semi-Markov conditional random field.

A text is scanned for anchors (addresses' @, digits, quoted values), each
anchor gives a few candidate segments of bounded length with a type, and every segment gets a score from features of the whole span: its
shape, its digits and their check sum, what stands before it and where it is
cut. A dynamic programme over each island of touching candidates chooses the
boundaries and types with the highest total; outside candidates the model is
sure of "no entity", so islands are independent.

Weights are learned by the averaged structured perceptron on a bounded sample
of documents, with the spans of the base rules and of plainly assigned secrets
as labels. Base spans are always kept; the field adds spans of its own.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
FIT_DOCUMENTS = 2000
FIT_ROUNDS = 4

# The base rules; fixed values.
# (A run of digits is entered at its start only; a later start in it could not match either.)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. A match must reach its @, so it is enough to look back from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules in the order email, ip, card, phone, then by start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- candidates

# Places worth a look: digits in some number, an @ or a spelled-out one, a quoted or assigned long value.
_ANCHOR = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}|[0-9][0-9 ().+-]{6,}[0-9]|@|[\[(]at[\])]| at (?=[\w-]+ dot )|\b[A-Za-z0-9+/_-]{20,}\b")
_SPARK = re.compile(r"[0-9@]|\bdot\b")  # without any of these there is nothing to find
_REACH = 80
_SECRET_BEFORE = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|key)\W{1,4}$", re.IGNORECASE)
_EDGE = re.compile(r"[\s\"'<>|,;]")


def _shape(s: str) -> str:
    """Classes of characters, runs shortened."""
    out = []
    for c in s:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:12]


def _anchors(text: str) -> Iterator[re.Match]:
    """Anchors in the neighbourhood of digits, @ and spelled-out dots, cut at white space where there is some."""
    lo = hi = -1
    for m in _SPARK.finditer(text):
        if m.start() < hi:
            continue
        lo = max(hi, m.start() - _REACH, 0)
        hi = m.end() + _REACH
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        while lo > 0 and lo > m.start() - 4 * _REACH and not text[lo - 1].isspace():
            lo -= 1
        yield from _ANCHOR.finditer(text, lo, min(hi, len(text)))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """Candidate (start, end, kind) segments around anchors: the base spans, and the anchor's run cut in several ways."""
    found = {(a, b, k) for k, a, b in base}
    for m in _anchors(text):
        a, b = m.start(), m.end()
        s = m[0]
        if s == "@" or "at" in s and s[0] in "[( ":
            lo, hi = a, b
            while lo > 0 and not _EDGE.match(text[lo - 1]) and a - lo < 64:
                lo -= 1
            while hi < len(text) and not _EDGE.match(text[hi]) and hi - b < 64:
                hi += 1
            if s != "@":  # "name at host dot org": three words more
                tail = re.compile(r"\s*[\w-]+(?:\s*(?:\.|[\[(]dot[\])]| dot )\s*[\w-]+)+").match(text, b)
                head = re.compile(r"[\w.+-]+\s*$").search(text, max(0, a - 64), a)
                if tail and head:
                    found.add((head.start(), tail.end(), "email"))
            elif hi > b and lo < a:
                found.add((lo, hi, "email"))
                stripped = text[lo:hi].rstrip(".!?:)]}*#%&$")
                found.add((lo, lo + len(stripped), "email"))
        elif s[0].isdigit() and len(d := _digits(s)) >= 7 and not s.isalnum() or s.isdigit():
            d = _digits(s)
            lo = a
            while lo > 0 and text[lo - 1] in "+(" and a - lo < 2:
                lo -= 1
            if s.count(".") == 3 and _shape(s) == "9.9.9.9":
                found.add((a, b, "ip"))
            if 9 <= len(d) <= 15 and not s.isdigit() or (lo < a and 9 <= len(d) <= 15):
                found.add((lo, b, "phone"))
            if 13 <= len(d) <= 19:
                found.add((a, b, "card"))
        else:
            found.add((a, b, "secret"))
    return sorted(x for x in found if x[1] > x[0])


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of a whole span as one segment of a type."""
    s = text[start:end]
    d = _digits(s)
    before = text[max(0, start - 12) : start]
    prev, after = before[-1:], text[end : end + 1]
    out = [
        "bias",
        f"shape={_shape(s)}",
        f"digits={min(len(d), 24)}",
        f"length={min(len(s) // 4, 12)}",
        f"cut={'w' if prev.isalnum() else 'p' if prev.strip() else 's'}{'w' if after.isalnum() else 'p' if after.strip() else 's'}",
        f"ends={'w' if s[-1].isalnum() else 'p'}",
    ]
    if kind == "card":
        out.append(f"luhn={luhn(d)}")
    if kind == "ip":
        out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in s.split('.') if p.isdigit())}")
    if kind == "email":
        tail = s.rpartition(".")[2] if "." in s else s.split()[-1]
        out += [f"dots={min(s.count('.'), 3)}", f"tail={min(len(tail), 5) if tail.isalpha() else 'x'}"]
    if kind == "phone":
        out += [f"plus={s[0] == '+'}", f"seps={min(sum(s.count(c) for c in ' ()-.'), 5)}"]
    if kind == "secret":
        out += [f"mixed={bool(d) and len(d) < len(s)}", f"named={bool(_SECRET_BEFORE.search(before))}", f"case={s.lower() == s}"]
    return [f"{kind}|{f}" for f in out]


# ---------------------------------------------------------------- the field


def islands(segments: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of candidates that overlap; a segmentation of one does not bear on another."""
    held: list[tuple[int, int, str]] = []
    reach = -1
    for x in segments:
        if held and x[0] >= reach:
            yield held
            held = []
        held.append(x)
        reach = max(reach, x[1]) if len(held) > 1 else x[1]
    if held:
        yield held


def best(island: list[tuple[int, int, str]], scores: list[float]) -> list[int]:
    """Indices of the non-overlapping segments of the highest total score, ties to fewer segments."""
    order = sorted(range(len(island)), key=lambda i: (island[i][1], island[i][0], island[i][2]))
    ends = [island[i][1] for i in order]
    total, choice = [0.0], [None]
    for n, i in enumerate(order):
        left = bisect.bisect_right(ends, island[i][0], 0, n)
        with_it = total[left] + scores[i]
        if with_it > total[n]:
            total.append(with_it)
            choice.append((i, left))
        else:
            total.append(total[n])
            choice.append(None)
    out, n = [], len(order)
    while n:
        if choice[n] is None:
            n -= 1
        else:
            out.append(choice[n][0])
            n = choice[n][1]
    return out[::-1]


def gold(text: str, base: list[tuple[str, int, int]]) -> set[tuple[int, int, str]]:
    """Labels for fitting: base spans and values plainly assigned to a secret's name."""
    out = {(a, b, k) for k, a, b in base}
    for m in re.finditer(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key)\s*[:=]\s*[\"']?([A-Za-z0-9+/_-]{16,})", text):
        out.add((m.start(1), m.end(1), "secret"))
    return out


def fit(docs: DataFrame, rounds: int = FIT_ROUNDS, most: int = FIT_DOCUMENTS) -> dict[str, float]:
    """Weights of the field from at most about ``most`` documents that hold an anchor, chosen by a hash of the text.

    Each sampled document's islands come to the driver as feature lists, not
    as texts. Features that one document alone has are left out.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"@|[0-9]{3}|[A-Za-z0-9]{20}"))
    n = texts.count()
    share = min(1.0, most / n) if n else 1.0
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).distinct()

    def prepared(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                base = base_spans(t)
                right = gold(t, base)
                for island in islands(candidates(t, base)):
                    rows.append(
                        {
                            "segments": [f"{a}:{b}:{k}" for a, b, k in island],
                            "gold": [x in right for x in island],
                            "features": [features(t, *x) for x in island],
                            "key": hash_of(t, island[0][0]),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=_PREPARED)

    kept = sample.mapInArrow(prepared, "segments array<string>, gold array<boolean>, features array<array<string>>, key string")
    data = kept.orderBy("key").limit(20 * most).collect()
    weights: dict[str, float] = {}
    sums: dict[str, float] = {}
    step = 0
    for _ in range(rounds):
        for r in data:
            step += 1
            island = [(int(a), int(b), k) for a, b, k in (s.split(":") for s in r["segments"])]
            scores = [sum(weights.get(f, 0.0) for f in fs) for fs in r["features"]]
            guess = set(best(island, scores))
            right = {i for i, g in enumerate(r["gold"]) if g}
            # Overlapping labels cannot all be segments; the first of them counts.
            true = set(best(island, [1.0 if i in right else -1.0 for i in range(len(island))]))
            for i in true - guess:
                for f in r["features"][i]:
                    weights[f] = weights.get(f, 0.0) + 1
                    sums[f] = sums.get(f, 0.0) + step
            for i in guess - true:
                for f in r["features"][i]:
                    weights[f] = weights.get(f, 0.0) - 1
                    sums[f] = sums.get(f, 0.0) - step
    return {f: w - sums[f] / (step + 1) for f, w in sorted(weights.items())}


def hash_of(text: str, at: int) -> str:
    return hashlib.md5(f"{at}:{text}".encode()).hexdigest()


_PREPARED = pa.schema(
    [("segments", pa.list_(pa.string())), ("gold", pa.list_(pa.bool_())), ("features", pa.list_(pa.list_(pa.string()))), ("key", pa.string())]
)


def spans_of(text: str, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    if not _SPARK.search(text):
        return [], []
    base = base_spans(text)
    have = set(base)
    for island in islands(candidates(text, base)):
        scores = [sum(weights.get(f, 0.0) for f in features(text, *x)) for x in island]
        for i in best(island, scores):
            a, b, k = island[i]
            have.add((k, a, b))
    place = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(have, key=lambda x: (place[x[0]], x[1], x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, weights: dict[str, float] | None = None, redact: bool = True) -> DataFrame:
    """(doc_id, base, spans, n_email, n_ip, n_card, n_phone and, if asked for, redacted) of every row of ``docs`` (doc_id, text).

    ``base`` and ``spans`` read ``kind:start:end`` joined by commas, in code
    points with the end exclusive. A null text is empty, ids are passed through
    as they are (null, repeated), other columns are ignored. Without
    ``weights`` the field is fitted on the table first.
    """
    model = fit(docs) if weights is None else weights
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([*_FOUND, *([("redacted", pa.string())] if redact else [])])

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in schema.names[1:]}
            for t in batch.column("text").to_pylist():
                base, spans = spans_of(t, model)
                out["base"].append(_joined(base))
                out["spans"].append(_joined(spans))
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(x[0] == k for x in base))
                if redact:
                    out["redacted"].append(redacted(t, spans) if spans else t)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out}, schema=schema)

    return texts.mapInArrow(run, "doc_id long, base string, spans string, n_email long, n_ip long, n_card long, n_phone long" + ", redacted string" * redact)


def redact(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` with each text redacted and all other columns as they are; a null text stays null."""
    model = fit(docs) if weights is None else weights

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [None if t is None else redacted(t, spans_of(t, model)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


_FOUND = [("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS)]
