"""Readers and writers of matrices."""
