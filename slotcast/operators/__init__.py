"""DataFrame operators on panels keyed by (series_id, ts)."""
