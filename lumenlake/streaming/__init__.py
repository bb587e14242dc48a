"""Streaming forms of the catalogue's batch work: an extension, as the catalogue itself has none."""
