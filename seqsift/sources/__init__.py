"""Collections on disk, and the files that tracks come from."""
