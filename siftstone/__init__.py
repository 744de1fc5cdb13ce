"""Siftstone: document ingestion, retrieval, rules, evaluation and corpus preparation on PySpark."""
