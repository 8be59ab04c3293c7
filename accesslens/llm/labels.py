"""Labels for training: the fold of a document and the one label that counts for it."""

from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col="doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def held_out(id_col="doc_id"):
    return fold(id_col) == 0


def training_labels(labels, column, id_col="doc_id"):
    """(doc_id, label) of the rows outside fold 0: null ids and labels are left out, the larger of several labels counts."""
    return (labels.select(F.col(id_col).alias("doc_id"), F.col(column).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.max("label").alias("label")))
