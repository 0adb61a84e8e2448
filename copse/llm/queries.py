"""One query per operator over its whole table, with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from copse.llm import bytebpe as BYTES, filters as AUDIT, hnsw as ANN, langid as LID, neardup as DUP, oracle as O, packing as PACK, pieces as PIECE, pii as PII, quality as Q, sharding as SHARD, spelling as SPELL, toxicity as TOX, wavelet as WAV
from copse.llm.batches import table
from copse.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build
    return add


@query("op1_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = LID.fit(docs, ~TOX.held_out())
    return LID.identified(docs, model).select(
        "doc_id", F.coalesce(TOX.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score",
        "cross_entropy", "rejected")


@query("op2_best_fit_packing")
def _(spark, sf_dir):
    rows = PACK.packed(PACK.pieces(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_nearest_neighbours")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ANN.nearest(rows, rows.where("vec_id % 20 = 0"))


@query("op4_pii")
def _(spark, sf_dir):
    rows = PII.found(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[PII.count_of(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                       F.sha2(PII.listed(base_only=True), 256).alias("base_sha256"), PII.listed().alias("spans"),
                       PII.count_of("term").alias("n_term"))


@query("op5_quality_rules", O.QUALITY)
def _(spark, sf_dir):
    rows = Q.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~Q.passes(Q.BASE)).alias("base_failed"), Q.passes(Q.STANDARD).alias("kept"),
                       "failed_bits")


@query("op6_pieces")
def _(spark, sf_dir):
    return PIECE.round_trips(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lexicon = TOX.learn(docs, table(spark, sf_dir, "labels"), ~TOX.held_out())
    rows = TOX.scored(docs, lexicon)
    return rows.select("doc_id", F.coalesce(TOX.held_out(), F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")


@query("op8_sharding")
def _(spark, sf_dir):
    rows = SHARD.sharded(SHARD.sized(table(spark, sf_dir, "documents")), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op9_near_duplicates")
def _(spark, sf_dir):
    return DUP.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def _(spark, sf_dir):
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid4().hex}"
    WAV.write(table(spark, sf_dir, "documents"), folder)
    return WAV.read(spark, folder)


@query("op11_byte_pieces")
def _(spark, sf_dir):
    return BYTES.digests(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants")
def _(spark, sf_dir):
    return SPELL.variants(SPELL.vocabulary(table(spark, sf_dir, "documents")))


@query("op13_filter_audit", O.FILTERS)
def _(spark, sf_dir):
    return AUDIT.audited(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
