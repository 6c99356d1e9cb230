"""Readers of corpora and mail, and the storage of models."""
