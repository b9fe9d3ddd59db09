"""One registered query per operator, over whole tables, and the SQL each must agree with where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm import bpe, brown, decontaminate, exact, licenses, near, periodic, pii, token_counts, tokenbin, toxicity, turn_trie, warc
from sunloom.llm.common import benchmark, documents, run_folder, staged

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(plan):
        PLANS[plan.__name__] = plan
        if sql is not None:
            ORACLES[plan.__name__] = sql
        return plan
    return keep


@query()
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.round_trip(documents(spark, folder).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
    FROM texts WINDOW same AS (PARTITION BY text)""")
def op2_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.marked(documents(spark, folder).select("doc_id", "text"), keep="largest")


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.schema("doc_id bigint, toxic int").parquet(f"{folder.rstrip('/')}/labels.parquet")
    found = toxicity.scored(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query()
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer, to = public_tokenizers.path("byte_bpe_50k.json"), run_folder(spark, "tokens")
    size = tokenbin.vocabulary_size(bpe.rank_file(tokenizer))
    tokenbin.write(tokenbin.encode(documents(spark, folder), tokenizer, 0, to), size, to)
    return tokenbin.read(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.pseudonymised(documents(spark, folder).select("doc_id", "text"), key="demonstration key")
    kinds = F.transform("replaced", lambda f: f["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.KINDS]
    counts = [(F.size("replaced") - n).cast("bigint").alias(f"n_{k}") for k, n in zip(pii.KINDS, counts)]
    return found.select("doc_id", "text", F.size("replaced").cast("bigint").alias("n_found"), *counts)


@query(r"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    items AS (
        SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(words), 10) AS width, list_slice(words, pos, pos + least(len(words), 10) - 1) AS win
        FROM items, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS t(pos) WHERE len(words) > 0),
    widths AS (SELECT DISTINCT width FROM windows),
    places AS (
        SELECT doc_id, width, pos, list_slice(words, pos, pos + width - 1) AS win
        FROM docs, widths, unnest(range(1, len(words) - width + 2)) AS t(pos)),
    hits AS (SELECT doc_id, p.width, pos, item_id FROM places p JOIN windows w ON p.width = w.width AND p.win = w.win),
    covered AS (
        SELECT doc_id, count(DISTINCT word) AS n_hit FROM hits, unnest(range(pos, pos + width)) AS t(word) GROUP BY doc_id),
    held AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
             FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, cast(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)""")
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scanned(documents(spark, folder).select("doc_id", "text"), benchmark(spark, folder))
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda total, s: total + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


@query()
def op7_near(spark: SparkSession, folder: str) -> DataFrame:
    found = near.grouped(documents(spark, folder).select("doc_id", "text"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query()
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", F.size("notices").cast("bigint").alias("n_notices"),
                        F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))).alias("families"),
                        F.array_max(F.transform("notices", lambda n: n["probability"])).alias("probability"))


@query()
def op9_brown(spark: SparkSession, folder: str) -> DataFrame:
    return brown.scored(documents(spark, folder), run_folder(spark, "brown")).withColumnRenamed("id", "doc_id")


@query("""
    WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    firsts AS (SELECT *, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM rows)
    SELECT page_id, cast(n AS bigint) AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM firsts""")
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.schema("page_id bigint, url string, html string").parquet(f"{folder.rstrip('/')}/pages.parquet")
    to = run_folder(spark, "warc")
    warc.write(warc.records(pages, to), f"{to}/archives")
    return warc.resolved(warc.read(spark, f"{to}/archives"))


@query()
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op12_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.schema("conv_id bigint, turn bigint, role string, text string").parquet(f"{folder.rstrip('/')}/conversations.parquet")
    to = run_folder(spark, "trie")
    c = F.col("conv_id")
    whole = staged(turn_trie.sequences(turns), to, "sequences")
    return turn_trie.nodes(turn_trie.continued(whole, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4), to)


def repeated_from(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted repetitions: of every tenth document, by a hash of its id, the words from a place on repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query()
def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.detected(documents(spark, folder), rewrite=repeated_from)
    # longest first, then by start and period: the order of the runs themselves breaks ties
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), "top.length", (-F.col("top.period")).alias("period"),
        F.floor(F.col("top.length") * 1000 / -F.col("top.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
