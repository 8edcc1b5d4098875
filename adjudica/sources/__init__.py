"""Sources: driver tables, file trees, ignore patterns, ranges, configuration, fixtures."""
