"""The queries opN_<name>: each operator with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .fingerprints import edited_fingerprints
from .line_dedup import dedup_lines
from .merkle import manifest, tampered
from .mixing import mix
from .near_dup import near_duplicates
from .oracles import MERKLE_SQL, SEARCH_SQL
from .quality import quality
from .search import search, write_index
from .token_counts import token_counts
from .token_files import read_tokens, write_tokens
from .toxicity import toxicity
from .urls import filter_urls
from .wrappers import extract


def vocabulary() -> str:
    """Place of the public tokenizer file; each executor has its own installed copy."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: target weights: sources count as domains by the tens of their number; other values weigh 1
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {
    "domain": {"web": 3.0, "curated": 2.0},
    "lang": {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0},
    "source": {"src0": 2.0, "src9": 1.5},
}


def with_domain(docs: DataFrame) -> DataFrame:
    """``domain`` of each source: web for one digit, curated for two, other for the rest."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.withColumn(
        "domain", F.when(source.rlike("^src[0-9]$"), "web").when(source.rlike("^src[0-9]{2}$"), "curated").otherwise("other")
    )


def op3_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_domain(table(spark, sf_dir, "documents")), MIX_LEVELS, MIX_WEIGHTS, budget=0.6, max_epochs=2, seed=17)


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op6_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary()))


#: given rules of the query: fixed values
URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


def op8_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(write_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered(F.col("doc_id"), F.col("text")))


def op13_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=512)


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_kneser_ney_quality": op2_kneser_ney_quality,
    "op3_hierarchical_mixing": op3_hierarchical_mixing,
    "op4_fuzzy_line_dedup": op4_fuzzy_line_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_one_permutation_fingerprints": op6_one_permutation_fingerprints,
    "op7_packed_token_ids": op7_packed_token_ids,
    "op8_url_association_rules": op8_url_association_rules,
    "op9_toxicity_cnn": op9_toxicity_cnn,
    "op10_html_wrappers": op10_html_wrappers,
    "op11_block_max_search": op11_block_max_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_bpe_token_counts": op13_bpe_token_counts,
}

def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {float(w)!r}::DOUBLE" for v, w in weights.items()) + " ELSE 1e0 END"


def _shared(name: str, parent: str, keys: str, weight: str, given: str) -> str:
    """SQL of a level of the tree: what each node gets of its parent's budget."""
    join = f"JOIN {given} USING ({parent})" if parent else f"CROSS JOIN {given}"
    part = f"PARTITION BY {parent}" if parent else ""
    last = keys.split(", ")[-1]
    return f"""{name}_n AS (SELECT {keys}, sum(cap) AS cap, any_value({weight}) AS weight FROM caps GROUP BY {keys}),
{name}_l AS (SELECT {keys}, cap, weight, (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {name}_n {join} WINDOW w AS ({part} ORDER BY cap / weight, {last})),
{name} AS (SELECT {keys}, least(cap, weight * greatest(max(level) OVER ({part}), 0e0)) AS budget FROM {name}_l)"""


ORACLE_SQL: dict[str, str] = {
    "op11_block_max_search": SEARCH_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
    "op3_hierarchical_mixing": rf"""WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src[0-9][0-9]$') THEN 'curated' ELSE 'other' END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
caps AS (SELECT *, CAST(tokens * 2 AS DOUBLE) AS cap, {_case("domain", MIX_WEIGHTS["domain"])} AS w1, {_case("lang", MIX_WEIGHTS["lang"])} AS w2, {_case("source", MIX_WEIGHTS["source"])} AS w3 FROM leaves),
whole AS (SELECT 0.6e0 * CAST(sum(tokens) AS DOUBLE) AS budget FROM leaves),
{_shared("a", "", "domain", "w1", "whole")},
{_shared("b", "domain", "domain, lang", "w2", "a")},
{_shared("c", "domain, lang", "domain, lang, source", "w3", "b")},
plan AS (SELECT domain, lang, source, CAST(floor(budget) AS BIGINT) // nullif(tokens, 0) AS epochs, CAST(floor(budget) AS BIGINT) % nullif(tokens, 0) AS rest FROM leaves JOIN c USING (domain, lang, source)),
drawn AS (SELECT d.*, coalesce(epochs, 0) AS epochs, coalesce(rest, 0) AS rest FROM d LEFT JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', 17, epochs, doc_id)), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn),
ended AS (SELECT *, CAST(greatest(0, least(n_tokens, rest - before)) AS BIGINT) AS last_tokens FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS BIGINT) AS epochs, last_tokens, CAST(epochs * n_tokens + last_tokens AS BIGINT) AS taken FROM ended""",
}
