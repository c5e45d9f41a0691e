"""cladewise: windowed host-relationship analytics on PySpark."""
