"""Sources: repository files, the knowledge JSON, chunks, repository lists and settings."""
