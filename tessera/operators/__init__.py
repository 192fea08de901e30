"""Relational operators: picks per key, joins, upserts, searches, classification, life cycles, monitors."""
