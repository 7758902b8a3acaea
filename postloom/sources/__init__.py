"""Readers and writers of corpora, metrics tables, logs and fingerprints."""
