"""Preparation of training text: deduplication, filtering, decontamination, conversations and tokens, as Spark jobs."""
