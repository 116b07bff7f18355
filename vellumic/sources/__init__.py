"""Readers and writers of files, pages and chapters."""
