"""Clinical analytics as Spark jobs: typed tables, layered lake, gates, metrics, statistics."""
