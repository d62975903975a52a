"""From documents to token files: the operators of loomsky.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads it again
as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsky.llm.common import broadcast_up_to, stored
from loomsky.llm.decontaminate import contaminated
from loomsky.llm.mixing import mix
from loomsky.llm.near_dup import near_duplicates
from loomsky.llm.quality import keep_good
from loomsky.llm.queries import MIX_LEVELS, MIX_WEIGHTS, table, vocabulary, with_domain
from loomsky.llm.token_files import read_tokens, write_tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to their language's threshold of perplexity. Null and empty texts go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at Jaccard 0.8 of 5-word shingles: the one with the smallest doc_id; of rows that share it,
    one. Rows without a doc_id stay."""
    classes = stored(near_duplicates(docs).select("doc_id", "kept"))
    gone = broadcast_up_to(stored(classes.where("not kept").select("doc_id").distinct()))
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = stored(classes.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        one = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(repeated, "doc_id", "left_anti").unionByName(one)
    return left.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows without a doc_id can't be matched and stay."""
    found = broadcast_up_to(stored(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()))
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents of the token prefixes that fill the target weights, as often as the epochs take them. Rows without a doc_id
    can't be drawn and go."""
    taken = mix(with_domain(docs), MIX_LEVELS, MIX_WEIGHTS, budget=0.8, max_epochs=2, seed=17)
    copies = F.col("epochs") + F.when((F.col("last_tokens") == F.col("n_tokens")) & (F.col("n_tokens") > 0), 1).otherwise(0)
    taken = taken.groupBy("doc_id").agg(F.max(copies).cast("int").alias("_copies")).where("_copies > 0")
    return docs.join(broadcast_up_to(stored(taken)), "doc_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    return read_tokens(write_tokens(docs, vocabulary()))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token-ID output", token_stage),
]

#: SQL can't express the model, the signatures, the alignment or the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
