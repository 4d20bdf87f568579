"""Queries over the shared test tables, each with an independent SQL counterpart."""

MODULES = ["ingest", "stored", "lookups", "aggregates", "scalars", "featureset", "scoring", "learned", "alerting", "streams"]
