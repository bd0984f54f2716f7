"""All queries outside the corpus-preparation folder, by name, and their SQL where there is any."""

from __future__ import annotations

from veldspar.plans import answer_queries, chat_queries, extraction_queries, relational_queries, retrieval_queries, text_queries

ALL = text_queries.QUERIES | retrieval_queries.QUERIES | chat_queries.QUERIES | answer_queries.QUERIES | extraction_queries.QUERIES | relational_queries.QUERIES
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql}
