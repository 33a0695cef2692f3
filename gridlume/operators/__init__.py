"""DataFrame operators: ingest, roll-up, enrichment, geometry, paging, state and features."""
