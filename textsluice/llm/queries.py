"""Registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textsluice.llm.common import kept
from textsluice.llm import (decontam, extract, filteraudit, lexical, packing, quality, shards, simhash, substrings, tokencount, tokenfile,
                            topk, warc)
from textsluice.session import ensure_checkpoint_dir
from textsluice.sources.tables import table

#: Shards that documents are put into.
SHARDS = 16


def tokenizer() -> str:
    """The tokenizer file; the same path on driver and executors."""
    return os.environ.get("TEXTSLUICE_TOKENIZER", public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash fingerprints of documents and the groups they link to."""
    return simhash.near_groups(table(spark, sf, "documents")).select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in shards of near equal bytes through virtual slots."""
    placed = shards.sharded(table(spark, sf, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


def op3_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of documents that repeat an earlier document's."""
    return substrings.repeats(table(spark, sf, "documents")).select("doc_id", "kept_doc_id", "start_word", "end_word", "n_words")


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages archived as WARC files, read back and assembled to captures."""
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf, "pages"), path)
    found = kept(warc.resolved(warc.read_captures(spark, path, payloads=False)), "captures")
    first = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("lead"),
                                                           F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    again = found.where("record_type = 'revisit'").join(first, "refers_to", "left").select(
        "page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("lead").alias("refers_to"))
    return (found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
            .unionByName(again))


def op5_decontam(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    return decontam.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return packing.packed(table(spark, sf, "documents"), tokenizer())


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest codes of every twentieth vector."""
    codes = topk.codes(table(spark, sf, "embeddings"))
    return topk.nearest(codes, codes.where("vec_id % 20 = 0"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores of documents; fold 0 is held out of fitting."""
    docs = table(spark, sf, "documents")
    scored = quality.scored(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", (quality.remainder() == 0).alias("held_out"), "score", "predicted")


def op9_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of documents."""
    return tokencount.token_counts(table(spark, sf, "documents"), tokenizer())


def op10_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of pages."""
    return extract.extracted(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_tokenfile(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of documents in Simple-8b files, read back."""
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return tokenfile.round_trip(table(spark, sf, "documents"), tokenizer(), path)


def op12_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 documents that match each benchmark item best."""
    return lexical.search(lexical.index(table(spark, sf, "documents")), table(spark, sf, "benchmark"))


def op13_filteraudit(spark: SparkSession, sf: str) -> DataFrame:
    """What five filters remove from documents in every order."""
    return filteraudit.audited(table(spark, sf, "documents"), table(spark, sf, "labels"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_sharding, op3_substrings, op4_warc, op5_decontam, op6_packing, op7_topk, op8_quality,
                                   op9_tokens, op10_extract, op11_tokenfile, op12_lexical, op13_filteraudit)}

ORACLES = {
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS lead FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> lead THEN lead END AS refers_to
        FROM g""",
    "op7_topk": """
        WITH c AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))::UBIGINT AS code
                   FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code))::BIGINT AS distance FROM c q, c v WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
        SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10""",
    "op12_lexical": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
        p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s
              WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
        x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
              FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_filteraudit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        k AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
                     min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        f AS (SELECT doc_id, part,
                     (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
                     + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
                     + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS flags FROM k),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, flags, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
        o AS (SELECT b1.f || b2.f || b3.f || b4.f || b5.f AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
              FROM b b1, b b2, b b3, b b4, b b5 WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31
                AND (b1.bit | b2.bit | b3.bit | b4.bit | b5.bit) = 31),
        s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(i)),
        m AS (SELECT part, filter_order, step, bit, before, flags, n, good, toxic, flags & bit <> 0 AS fails, flags & before <> 0 AS gone
              FROM s, (SELECT DISTINCT part FROM t) p JOIN c USING (part)),
        g AS (SELECT part, filter_order, step, bit,
                     coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (flags = bit), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
              FROM m GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g""",
}
