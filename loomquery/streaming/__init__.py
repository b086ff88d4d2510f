"""The same plans over streams: a catalog may hold streaming tables, whose grouped aggregates run in event-time windows."""
