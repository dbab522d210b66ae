"""Sources: canonical tables of files, notes, vectors and queries."""
