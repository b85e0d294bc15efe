"""Sources and sinks: landed payloads, pages, day tables, sheets."""
