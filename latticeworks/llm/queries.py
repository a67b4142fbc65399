"""Registered queries of the subpackage, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.llm import language, toxicity
from latticeworks.llm.class_lm import score_texts
from latticeworks.llm.common import held_out, table
from latticeworks.llm.conversations import damaged, repair, report
from latticeworks.llm.decontamination import matches
from latticeworks.llm.exact_dedup import deduplicate
from latticeworks.llm.licenses import TEMPLATES, scan
from latticeworks.llm.line_dedup import remove_boilerplate
from latticeworks.llm.packing import pack
from latticeworks.llm.periodic import collapse_runs, with_echoes
from latticeworks.llm.simhash import near_duplicates
from latticeworks.llm.substring_dedup import remove_repeats
from latticeworks.llm.token_counts import count_tokens

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query("""
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), reach=2, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, size=4096)


@query("""
WITH l AS (
    SELECT doc_id, source, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), k AS (SELECT *, trim(replace(replace(raw, chr(9), ' '), chr(13), ' '), ' ') AS line FROM l),
spread AS (
    SELECT line, min(row(doc_id, pos)) AS first FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), m AS (
    SELECT k.doc_id, k.pos, k.raw, spread.line IS NOT NULL AND row(k.doc_id, k.pos) <> spread.first AS gone
    FROM k LEFT JOIN spread USING (line)
), r AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
    FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def _templates_sql() -> str:
    rows = ", ".join("('" + name + "', '" + body.replace("'", "''") + "')" for name, body in TEMPLATES)
    return f"(VALUES {rows}) AS t(license, body)"


_WORDS = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')"
_BIGRAMS = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"


@query(f"""
WITH t AS (SELECT license, {_BIGRAMS} AS g FROM (SELECT license, {_WORDS.format('body')} AS w FROM {_templates_sql()})),
p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
u AS (
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS unit FROM p
    UNION ALL SELECT doc_id, -1, text FROM p WHERE len(parts) > 1
), g AS (SELECT doc_id, line_no, {_BIGRAMS} AS a FROM (SELECT doc_id, line_no, {_WORDS.format('unit')} AS w FROM u) WHERE len(w) > 1),
s AS (
    SELECT doc_id, line_no, license, len(list_intersect(x.a, t.g)) * 2.0::DOUBLE / (len(x.a) + len(t.g)) AS dice
    FROM g AS x CROSS JOIN t
)
SELECT doc_id, line_no::INTEGER AS line_no, min(license) AS license, dice
FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, line_no) AS top FROM s) WHERE dice = top AND dice >= 0.8
GROUP BY ALL
""")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), least=0.8)


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.6, overlap=0.8)
    return found.select("doc_id", "item_id", "score", "shingle_overlap", "question_overlap", "answer_overlap")


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_echoes(table(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("top", F.array_min(ranked))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = report(repair(damaged(rows)))
    every = rows.select("conv_id").distinct().alias("c").join(found.alias("f"), F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("c.conv_id", *counts, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query()
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held(key):
        return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))

    found = score_texts(table(spark, sf_dir, "documents"), ~held("doc_id"))
    return found.select("doc_id", held("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
