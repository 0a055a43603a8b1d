"""Readers and writers: documents, point collections, reply lines, search results."""
