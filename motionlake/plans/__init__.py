"""Named queries and their equivalents in ANSI SQL."""
