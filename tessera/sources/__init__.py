"""Readers: dump XML, id lists, document folders, category tables, artifacts."""
