"""Readers and writers: mixed files, web pages, chunk tables, caches."""
