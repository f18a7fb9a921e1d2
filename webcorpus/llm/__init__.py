"""Operators for preparing training data: packing, scans, joins, extraction, rules and scoring."""
