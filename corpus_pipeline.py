"""The corpus pipeline: STAGES over the table documents, each stage on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.bpe import bpe_encode
from tidewell.llm.common import maybe_in, saved
from tidewell.llm.cube_mix import WORD, cube_mix
from tidewell.llm.pii import pii_clean
from tidewell.llm.textmodel import quality_scores
from tidewell.llm.tjoin import jaccard_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses a trained classifier, a random draw or BPE; tests compare with a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text gets the model's bias for a score (0.5, so rejected, where nothing is labelled).  Rows are judged one
    by one, so repeated rows stay or go together; null ids, languages and sources make no difference; no rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or through others, the one of smallest id.

    Rows that repeat a doc_id are one document, of which one row stays; rows without a doc_id stay.
    """
    found = saved(jaccard_join(docs, n=5, similarity=(80, 100)).where("doc_id is not null"), "groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    twice = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id")
    split = maybe_in(docs, "doc_id", gone.unionByName(twice), "_id")  # most documents stay where they are
    some = split.where("_maybe and doc_id is not null").join(gone, F.col("doc_id") == F.col("_id"), "left_anti").dropDuplicates(["doc_id"])
    return some.select(*COLUMNS).unionByName(split.where("not _maybe or doc_id is null").select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it replaced in the text.

    A null text stays null and keeps its n_chars; every row stays, repeated ones and those without an id too; no rows give
    no rows.
    """
    return pii_clean(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null text has size 0; null sources are one source, null ids one id.  Rows that agree in id, source and size share what
    was taken of them evenly, the rest going by text (ties are equal rows); no rows give no rows.
    """
    taken = cube_mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    taken = saved(taken, "mix").withColumnsRenamed({"doc_id": "_id", "source": "_source", "size": "_size"})
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sized = docs.select(*COLUMNS, size.alias("size"))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    # rows that agree in id, source and size share what was taken of them
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("text"))
    share = F.floor(F.col("times") / F.col("rows")) + F.when(nth <= F.col("times") % F.col("rows"), 1).otherwise(0)
    dealt = sized.join(taken, match).withColumn("share", share.cast("int")).where("share > 0")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("share")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids and the text decoded from them, of every document of the mix.

    A null text counts as empty (no ids, decoded ''); rows map one to one, so repeated rows and null ids stay; no rows give
    no rows.
    """
    import public_tokenizers  # here, so that a missing vocabulary package stops this stage only

    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids", "decoded"))


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
