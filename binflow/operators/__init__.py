"""Relational operators: filters, joins, features, metrics, models, detections."""
