"""pagelode: a Spark-native engine for curating and benchmarking corpora of labelled web pages."""

__version__ = "0.1.0"
