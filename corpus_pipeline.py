"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
every stage's result as Parquet into the cluster's shared scratch folder and reads it back as the
next one's documents.  All stages but the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. line_dedup: lines whose template recurs across documents go from the texts.
3. near_dedup: of each group of exact or near copies one document stays.
4. mixing: documents are sampled so that their words meet target shares.
5. packing: the documents' tokens are packed into sequences.

Defined cases are those of the operators (``redline.llm``); a document whose lines all go stays
with an empty text, and empty texts are no copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm import line_dedup as lines
from redline.llm import near_dedup as copies
from redline.llm import packing as pack
from redline.llm import queries
from redline.llm import toxicity as tox
from redline.llm.common import begin, release, stored
from redline.sources.tables import table

#: Chunks that a worker remembers in the last stage: the executors still hold what earlier stages left.
CACHE_BYTES = 64 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    release(spark)
    return tox.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    release(spark)
    left = lines.drop_recurring_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    release(spark)
    return copies.drop_near_duplicates(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    release(spark)
    return queries.mixed(docs.select(*COLUMNS)).filter("selected").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    release(spark)
    return pack.pack_documents(docs.select("doc_id", "text"), queries.tokenizer_path("word_bpe_49k.json"), cache_bytes=CACHE_BYTES)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing),
          ("packing", packing)]

#: A trained classifier, raking and hashing of shingles have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
