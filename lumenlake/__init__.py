"""A PySpark engine for searching, browsing and organising a media catalogue."""
