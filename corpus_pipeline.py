"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
rereads it as the next stage's documents. All stages but the last return the columns of ``docs``. Null ids and texts,
repeated rows, empty tables and extra columns are allowed; extra columns must not begin with an underscore.
"""

import public_tokenizers
from pyspark.sql import functions as F

from accesslens.llm.common import stored
from accesslens.llm.line_dedup import dedup_lines
from accesslens.llm.ngram_join import keep_first
from accesslens.llm.packing import pack_documents
from accesslens.llm.pii import sanitise
from accesslens.llm.quality import keep_good


def _prepare(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Text rows are long: small Arrow batches bound a Python worker's memory.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def _sized(docs, columns):
    """The given columns, n_chars (where there is one) renewed for the new text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality(spark, docs, sf_dir):
    """Documents whose text the rule ensemble rejects go."""
    _prepare(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark, docs, sf_dir):
    """Blocks of lines that an earlier document has are deleted; a document that loses four fifths of its characters so
    is a near copy of earlier ones and goes, as does one left without any word."""
    _prepare(spark)
    found = dedup_lines(docs.withColumn("_whole", F.length("text")))
    own = F.col("text").rlike(r"\S") & (5 * F.length("text") > F.col("_whole"))
    return _sized(found.where((F.col("removed_lines") == 0) | own), docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked by 4-word shingles, the one with the smallest id stays."""
    _prepare(spark)
    return keep_first(docs)


def personal_data(spark, docs, sf_dir):
    """Personal data and disclosing terms are replaced in the text; every document stays."""
    _prepare(spark)
    return _sized(sanitise(docs), docs.columns)


def packing(spark, docs, sf_dir):
    """Token pieces of all documents in sequences of 2048."""
    _prepare(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", packing)]

#: A trained model, an alignment and a tokenizer have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces of the packed corpus, after all stages over ``documents``."""
    _prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
