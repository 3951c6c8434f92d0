"""Readers and writers of rule sets, logs, manifests and saved runs."""
