"""The corpus pipeline: documents in, token ids out, by five stages of which each works on all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneloom.llm import mixing, near_copies, pieces, pii, quality_lm
from paneloom.llm.common import stored
from paneloom.llm.queries import DOMAINS, MODEL, WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARE = (4, 5)     # of the words that reach the mixing stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    return quality_lm.keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: found by SimHash, checked exactly (five words a shingle, similarity 0.8
    or more); pairs that SimHash does not find come by prefix filtering."""
    return near_copies.keep_one(docs.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced by its kind."""
    docs = docs.select(COLUMNS)
    return pii.redact(docs, pii.train(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents within each source's budget, each at most once."""
    return mixing.mixed_rows(docs.select(COLUMNS), domains=DOMAINS, weights=WEIGHTS, share=SHARE, max_epochs=1, seed="pipeline")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and whether they decode to the text."""
    v = pieces.Vocabulary.load(MODEL)
    out = pieces.decode(pieces.encode(docs, v), v)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"),
                      (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None  # XXH64 fingerprints, the language model and the lattice are beyond SQL; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
