"""Relational building blocks: lookups, upserts, climatology, scores, serving."""
