"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay_spark.llm.backoff_lm import score_documents
from assay_spark.llm.chat_tree import conversation_messages, format_trees, learned_text, read_back
from assay_spark.llm.common import table
from assay_spark.llm.jaccard_join import jaccard_components
from assay_spark.llm.lang_crf import fit_language_model, held_out, identify
from assay_spark.llm.pattern_pack import pack_documents
from assay_spark.llm.piece_codec import piece_digests
from assay_spark.llm.site_quality import judge
from assay_spark.llm.syncmers import fingerprint_edits
from assay_spark.llm.token_offsets import section_tokens
from assay_spark.llm.toxicity import fit_toxicity, score_toxicity
from assay_spark.llm.toxicity import held_out as not_learned
from assay_spark.llm.vector_graph import near_duplicates
from assay_spark.llm.whitening import whiten_components
from assay_spark.llm.word_runs import collapse_runs, echo_some, runs_digest, strongest_run


def op1_lang_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: the language of every whole text; learned without the held-out documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: ids of every whole text and their decoding, as digests."""
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: components of documents whose 3-word shingle sets are 90 % alike or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: stupid-backoff score of every document over whole words, with counts of all other documents."""
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumn("lm_score", F.round("lm_score", 6))


def op5_pattern_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: all documents packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_len=4096, end_id=1)


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: all conversations as reply trees, formatted; digests are read back from the output."""
    own = spark.createDataFrame([(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))],
                                "conv_id bigint, turn bigint, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = conversation_messages(given.unionByName(own))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            turns = [read_back(t) for t in b["formatted"]]
            loss = [learned_text(t, s) for t, s in zip(b["formatted"], b["loss_spans"])]
            yield pd.DataFrame({
                "path": b["path"], "n_turns": [len(t) for t in turns],
                "turns_sha256": [sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns],
                "loss_chars": [len(x) for x in loss], "loss_sha256": [sha(x) for x in loss],
                "formatted_chars": [len(t) for t in b["formatted"]]})

    read = format_trees(messages).select("path", "formatted", "loss_spans").mapInPandas(
        digest, "path string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    conv = F.when(F.substring_index("path", ":", 1) != "null", F.substring_index("path", ":", 1)).cast("bigint")
    return read.select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: links and components of vectors of one label with cosine 0.93 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: quality and toxicity of every document, with its source as host and source/language as path."""
    path = F.concat_ws("/", "source", "lang")
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), path)
    return judged.drop("text_hash")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: fingerprints of every whole text and of its edited text."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: tokens of every line of every whole text."""
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN, rule="start")


def op11_toxic_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: the toxicity of every whole text; learned without the held-out documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs.where(~not_learned()), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", not_learned().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: the first 16 whitened components of every usable vector (null deviation: beyond a long)."""
    out = whiten_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", most=16)
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: periodic runs of every whole text, some with a repeating end, and digests of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", echo_some(F.col("doc_id"), F.col("text")).alias("text"))
    found = collapse_runs(docs).withColumn("best", strongest_run(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lang_crf": op1_lang_crf,
    "op2_piece_codec": op2_piece_codec,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_backoff_lm": op4_backoff_lm,
    "op5_pattern_pack": op5_pattern_pack,
    "op6_chat_tree": op6_chat_tree,
    "op7_vector_graph": op7_vector_graph,
    "op8_site_quality": op8_site_quality,
    "op9_syncmers": op9_syncmers,
    "op10_token_offsets": op10_token_offsets,
    "op11_toxic_subwords": op11_toxic_subwords,
    "op12_whitening": op12_whitening,
    "op13_word_runs": op13_word_runs,
}

_ESC = "replace(replace(replace({}, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '>', chr(92) || 'g')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op4_backoff_lm": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
        g AS (SELECT doc_id, pos, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM w),
        o1 AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY ALL),
        c1 AS (SELECT w, sum(c) AS c FROM o1 GROUP BY ALL),
        o2 AS (SELECT doc_id, v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY ALL),
        c2 AS (SELECT v, w, sum(c) AS c FROM o2 GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY ALL),
        t AS (SELECT sum(c) AS n, count(*) AS v FROM c1),
        s AS (SELECT g.doc_id, CASE WHEN c2.c > o2.c THEN ln(c2.c - o2.c) - ln(cv.c - ov.c)
                     ELSE CASE WHEN g.v IS NULL THEN 0 ELSE ln(0.4) END + ln((cw.c - ow.c + 1) / (t.n - n.n + t.v)) END AS s
              FROM g CROSS JOIN t JOIN n USING (doc_id)
                     JOIN c1 cw ON cw.w = g.w JOIN o1 ow ON ow.doc_id = g.doc_id AND ow.w = g.w
                     LEFT JOIN c1 cv ON cv.w = g.v LEFT JOIN o1 ov ON ov.doc_id = g.doc_id AND ov.w = g.v
                     LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w
                     LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.v = g.v AND o2.w = g.w)
        SELECT d.doc_id, count(s.s) AS n_words, round(sum(s.s) / nullif(count(s.s), 0), 6) AS lm_score
        FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
    "op6_chat_tree": f"""
        WITH t AS (
            SELECT conv_id, turn, role AS r0, text AS t0 FROM conversations
            UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
        u AS (SELECT conv_id, turn, r0, t0, coalesce(r0, '') AS role, coalesce(t0, '') AS text FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
                                 ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
               sum(length('<turn:' || {_ESC.format('role')} || '>.' || {_ESC.format('text')} || '</turn>.'))::BIGINT AS formatted_chars
        FROM u GROUP BY conv_id""",
}
