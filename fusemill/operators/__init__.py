"""See README: operators."""
