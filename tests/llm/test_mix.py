"""The schedule's deadlines and deviation, and the distributed placement against a plain one."""

import hashlib
import math
from collections import defaultdict

from freshet.llm import mix
from freshet.llm.queries import QUERIES


def test_deadlines_and_deviation():
    for weights in ({"a": 1, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {f"s{i}": (i + 1) ** 2 for i in range(17)}, {None: 3, "": 1, "x": 0.001}):
        per = mix.quotas(weights, 256)
        assert sum(per.values()) == 256 and all(c >= 1 for c in per.values())
        got = mix.schedule(per)
        assert [t for *_, t in got] == list(range(256))
        done = defaultdict(int)
        for s, j, release, deadline, slot in got:
            assert (release, deadline) == (j * 256 // per[s], math.ceil((j + 1) * 256 / per[s])) and release <= slot < deadline and done[s] == j
            done[s] += 1
            assert all(abs(done[k] * 256 - per[k] * (slot + 1)) < 256 for k in per)


def test_quotas_without_weights():
    assert mix.quotas({}) == {} and mix.quotas({"a": 0, "b": None, "c": math.nan}) == {}
    assert mix.quotas({"a": 1e-12, "b": 1.0}, 8) == {"a": 1, "b": 7}


def plain(rows, weights, block, period, seed="mix"):
    """Simulates slot after slot."""
    per = mix.quotas(weights, period)
    queues = defaultdict(list)
    for i, s in rows:
        queues[s].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i))
    for q in queues.values():
        q.sort(key=lambda x: x[0])
    out = [(i, s, None, None) for s, q in queues.items() if s not in per for _, i in q]
    done, slot = defaultdict(int), 0
    while any(done[s] * block < len(queues[s]) for s in per if s in queues):
        free = [s for s in per if done[s] * period // per[s] <= slot]
        s = min(free, key=lambda s: (-(-(done[s] + 1) * period // per[s]), list(per).index(s)))
        for place, (_, i) in enumerate(queues[s][done[s] * block : (done[s] + 1) * block]):
            out.append((i, s, slot, place))
        done[s] += 1
        slot += 1
    return sorted(out, key=repr)


def test_placement(spark):
    rows = [(i, f"s{i * i % 7}" if i % 11 else None) for i in range(700)] + [(9000, "unweighted"), (None, "s0"), (9001, "")]
    weights = {"s0": 5, "s1": 1, "s2": 2, "s4": 2.5, None: 1, "": 0.5}
    df = spark.createDataFrame([(i, s, -1, 0, "x") for i, s in rows], "doc_id long, source string, mix_slot int, _k int, _row string")
    got = mix.interleave(df, weights, block_rows=5, period=64)
    assert got.columns == ["doc_id", "source", "_k", "_row", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]
    have = sorted(((r["doc_id"], r["source"], r["mix_slot"], None if r["mix_slot"] is None else r["mix_place"]) for r in got.collect()), key=repr)
    assert have == plain(rows, weights, 5, 64)
    assert mix.interleave(df.limit(0), weights).count() == 0 and mix.interleave(df, {}).where("mix_slot IS NULL").count() == len(rows)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["source"], r["mix_slot"], r["mix_place"]) for r in QUERIES["op9_mix"](spark, sf).collect()), key=repr)
    assert got == plain(rows, mix.tempered(docs), mix.BLOCK_ROWS, mix.PERIOD)
