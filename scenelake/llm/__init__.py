"""Operators a training-data pipeline needs: tokens, mixing, filters, archives, joins and search over texts."""
