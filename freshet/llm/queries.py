"""Queries that apply the operators to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import chat, convtrie, jaccard, merkle, mix, packing, passages, pieces, pii, topk, toxicity, warc, winnow
from freshet.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # Executors need not have the package installed.
            return fn(ship(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def piece_model() -> str:
    """Path of the vocabulary; ``PIECE_MODEL`` names another one."""
    given = os.environ.get("PIECE_MODEL")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pack_vocabulary() -> str:
    """Path of the packing's vocabulary; ``PACK_MODEL`` names another one."""
    given = os.environ.get("PACK_MODEL")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op4_winnow")
def op4_winnow(spark: SparkSession, sf: str) -> DataFrame:
    done = winnow.compare_neighbours(table(spark, sf, "documents"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        winnow.as_text("fp").alias("fingerprint"),
        winnow.as_text("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query(
    "op5_chat",
    r"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations),
    s AS (
        SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS len,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER
                   (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre,
               list(struct_pack(r := role, x := text)) OVER
                   (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turns
        FROM t),
    whole AS (
        SELECT min(conv_id) AS conv_id, len AS n_turns, count(*) AS n_copies, pre AS rendered, turns
        FROM s WHERE pos = len GROUP BY len, pre, turns)
    SELECT conv_id, n_turns, n_copies, rendered FROM whole w
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.pos = w.n_turns AND s.len > s.pos AND s.turns = w.turns)
    """,
)
def op5_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.render(table(spark, sf, "conversations"))


@query("op9_mix")
def op9_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mix.interleave(docs, mix.tempered(docs))


@query(
    "op6_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op6_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


@query(
    "op7_warc",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
    FROM k
    """,
)
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.write(table(spark, sf, "pages"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_jaccard")
def op2_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.classes(table(spark, sf, "documents"))


@query("op1_pii")
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents"), redact=False)
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE_KINDS], F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_pieces")
def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    model = piece_model()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    back = pieces.decode(pieces.encode(docs, model, rate=0.1, seed=1), model)
    return back.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query("op3_passages")
def op3_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf, "documents"))


# Unsigned CRC-32 of the decimal text of a number, by its polynomial.
_CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: xor(t >> 1, 3988292384 * (t & 1)))))"""


@query(
    "op11_trie",
    f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t2 AS (
        SELECT *, substr(sha256(strlen(role)::VARCHAR || ':' || role || text), 1, 32) AS id FROM t),
    c AS (
        SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, id) AS seq,
               CAST({_CRC.format("conv_id")} % 9 AS INTEGER) AS h
        FROM t2 GROUP BY conv_id),
    r AS (
        SELECT c.conv_id, list_concat(coalesce(b.seq[1:c.h], []), c.seq[c.h + 1:]) AS seq
        FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
    p AS (
        SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
    n AS (
        SELECT depth, seq[1:depth] AS pre, min(conv_id) AS conv_id, count(*) AS n_convs,
               string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends
        FROM p GROUP BY depth, seq[1:depth]),
    m AS (
        SELECT n.*, u.conv_id AS parent, count(k.depth) AS n_children
        FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.pre = n.pre[1:n.depth - 1]
               LEFT JOIN n k ON k.depth = n.depth + 1 AND k.pre[1:n.depth] = n.pre
        GROUP BY ALL),
    a AS (
        SELECT unnest(range(0, depth + 1)) AS depth, pre AS whole, n_children, (n_convs - 1) * (CASE WHEN depth > 0 THEN strlen(pre[depth].x) ELSE 0 END) AS saved
        FROM m),
    s AS (
        SELECT depth, whole[1:depth] AS pre, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
        FROM a GROUP BY depth, whole[1:depth])
    SELECT m.conv_id, m.depth, m.parent AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens,
           sha256(coalesce(m.ends, '')) AS ends_sha256
    FROM m JOIN s ON s.depth = m.depth AND s.pre = m.pre
    """,
)
def op11_trie(spark: SparkSession, sf: str) -> DataFrame:
    convs = convtrie.with_shared_heads(convtrie.conversations(table(spark, sf, "conversations")))
    return convtrie.trie(convs).drop("turn_id")


@query("op12_pack")
def op12_pack(spark: SparkSession, sf: str) -> DataFrame:
    pieces_ = packing.pack(table(spark, sf, "documents"), pack_vocabulary())
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))


@query(
    "op13_manifest",
    f"""
    WITH RECURSIVE d AS (
        SELECT *, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
               sha256({_LEAF} || {_FIELD.format("low")}) AS changed
        FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_CRC.format("doc_id")} % 3 = 0
                             THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low
              FROM documents)),
    o AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
        FROM d),
    lv AS (
        SELECT 0 AS depth, lang, pos, n, leaf AS h FROM o
        UNION ALL
        SELECT depth + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY depth, lang, pos // 8, n),
    sub AS (
        SELECT lang, h AS subroot, depth AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM lv WHERE n = 1),
    up AS (
        SELECT 0 AS depth, pos, n, subroot AS h FROM sub
        UNION ALL
        SELECT depth + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY depth, pos // 8, n),
    sib AS (
        SELECT a.lang, a.depth, a.pos,
               coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
               coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM lv a JOIN lv b ON a.lang IS NOT DISTINCT FROM b.lang AND a.depth = b.depth AND a.pos // 8 = b.pos // 8
        WHERE a.n > 1 GROUP BY a.lang, a.depth, a.pos),
    top AS (
        SELECT a.depth, a.pos,
               coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
               coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM up a JOIN up b ON a.depth = b.depth AND a.pos // 8 = b.pos // 8
        WHERE a.n > 1 GROUP BY a.depth, a.pos),
    f AS (
        SELECT o.doc_id, o.lang, o.leaf, o.changed, o.pos, s.subroot, s.height, s.pos AS place, 0 AS k, o.pos AS spot, o.changed AS h, '' AS proof
        FROM o JOIN sub s ON o.lang IS NOT DISTINCT FROM s.lang
        UNION ALL
        SELECT f.doc_id, f.lang, f.leaf, f.changed, f.pos, f.subroot, f.height, f.place, f.k + 1,
               CASE WHEN f.k + 1 = f.height THEN f.place ELSE f.spot // 8 END,
               sha256(coalesce(sib.l, top.l) || f.h || coalesce(sib.r, top.r)),
               f.proof || coalesce(sib.l, top.l) || coalesce(sib.r, top.r)
        FROM (SELECT *, CASE WHEN height = 0 AND k = 0 THEN place ELSE spot END AS here FROM f) f
        LEFT JOIN sib ON f.k < f.height AND sib.lang IS NOT DISTINCT FROM f.lang AND sib.depth = f.k AND sib.pos = f.here
        LEFT JOIN top ON f.k >= f.height AND top.depth = f.k - f.height AND top.pos = f.here
        WHERE sib.l IS NOT NULL OR top.l IS NOT NULL),
    last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lang, pos ORDER BY k DESC) = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM last, (SELECT h AS root FROM up WHERE n = 1)
    """,
)
def op13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_of([F.translate("text", letters, letters.lower()) if c == "text" else F.col(c) for c in columns])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    manifest = merkle.build(docs, columns, group="lang", order="doc_id", carry={"changed": F.when(hit, tampered)})
    proofs = merkle.prove(manifest).withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return proofs.select(
        F.col("order").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
