"""Builders of derived tables: marts, innings summaries, player profiles and validation gates."""
