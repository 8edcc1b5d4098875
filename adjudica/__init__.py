"""A Spark engine for record adjudication: ingest, link, score, gate, report."""
