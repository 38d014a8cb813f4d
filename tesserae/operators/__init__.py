"""DataFrame operators: search, tables, evidence, chunks, catalog, evaluation."""
