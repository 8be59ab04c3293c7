"""Detection models as Spark ML stages that are fitted once, saved, loaded and applied to new batches."""
