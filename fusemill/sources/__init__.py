"""See README: sources."""
