"""Spark-native corpus curation: retrieval, holds, clustering, quotas, sampling, gates and verification."""
