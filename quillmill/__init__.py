"""A Spark-first engine for cleaning, measuring, cutting and splitting text corpora."""
