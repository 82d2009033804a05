"""Read-only SQL entry point and the registered query catalogue."""
