"""Operators for large training-data pipelines (deduplication, decontamination, tokenisation, sharding, archives)."""
