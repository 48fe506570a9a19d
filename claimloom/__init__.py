"""Claim reconciliation on Spark: documents in, disagreeing claims out."""
