"""Readers and writers for genomics text formats."""
