"""Readers and writers: catalogs, files, archives, definitions, graph tables."""
