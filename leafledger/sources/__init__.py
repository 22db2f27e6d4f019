"""Sources and sinks: collections from tables, log segments, document folders, snapshots."""
