"""Measured records with provenance: reconciliation, rules in three-valued logic, retrieval and scoring on Spark."""
