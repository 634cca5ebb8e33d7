"""Evidence retrieval over document corpora, written as Spark DataFrame operators."""
