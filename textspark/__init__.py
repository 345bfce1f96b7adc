"""Spark-first text analytics: tokenization, lexical statistics, retrieval and semantic operators."""
