"""Readers and writers of sequence, interval and catalog files."""
