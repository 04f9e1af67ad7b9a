"""cairn: analytics over collections of embedded items, on PySpark."""
