"""Scans and sinks: scorecard documents, tables, manifests, state, and the analogue over relational tables."""
