"""The corpus pipeline: five operators in turn over the whole table of documents.

Stages take (spark, docs, sf_dir) and return a DataFrame; each sees all that the one before it kept.  All but
the last return the columns of ``docs``, whatever they are called: operators read doc_id and text.

Defined results, for every stage: a null text is an empty one (it is kept, and stays null); no documents give no
documents; repeated rows are each judged alike; rows without an id are judged by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import _store, bpe, decontamination, jaccard, pii, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.  Null and empty texts stay; without labels all stay."""
    labels = _store.prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, 0.8) the one with the smallest doc_id stays.

    Rows that agree in doc_id and text are one document: the one whose other columns are least stays, nulls
    first.  Rows that share a doc_id but not the text go or stay together.  Texts without words are copies of
    nothing.  Rows without a doc_id are no copies of others, as no document is theirs.
    """
    found = jaccard.near_duplicates(docs, k=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.count() <= jaccard.BROADCAST_ROWS
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        least = docs.groupBy("doc_id", "text").agg(F.min(F.struct(*others, F.lit(0).alias("_0"))).alias("_least"))
        own = [F.col(c) if c in ("doc_id", "text") else F.col(f"_least.`{c}`").alias(c) for c in docs.columns]
        docs = least.select(*own)
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go; without items all stay."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become <KIND>; no document goes, and n_chars stays what the source stated."""
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", one_of_each),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]
#: Models and hashes of this kind have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written and read again, and go when the next one's are written."""
    docs = _store.prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    with _store.Workspace(spark, "pipeline") as space:
        for k, (name, stage) in enumerate(STAGES):
            before = list(space.temporary)
            docs = space.table(stage(spark, docs, sf_dir), name, keep=k == len(STAGES) - 1)
            _store.release()
            for path in before:
                space.drop(path)
                space.temporary.remove(path)
    return docs
