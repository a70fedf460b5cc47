"""Readers, writers (S1-S10) and the test-data fixtures."""

from quarry.sources.tables import (read_ap, read_articles, read_cleaned, read_embeddings, read_labelled_queries,
                                   read_queries, read_run, write_ap, write_answer, write_cleaned,
                                   write_derived_text, write_embeddings, write_run)

__all__ = ["read_articles", "read_labelled_queries", "read_queries", "read_cleaned", "write_cleaned",
           "read_embeddings", "write_embeddings", "write_derived_text", "write_answer", "write_ap", "read_ap",
           "write_run", "read_run"]
