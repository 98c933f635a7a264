"""Multi-stage plans: ingest, retrieval, workflow, cache, evaluation; and the query registry."""
