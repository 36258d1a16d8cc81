"""Readers and writers of invoice data."""
