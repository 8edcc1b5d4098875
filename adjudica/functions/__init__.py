"""Column functions: text, paths, hashes, scores."""
