"""newsloom: a Spark-first engine for news corpora and training-data preparation."""

__version__ = "0.1.0"
