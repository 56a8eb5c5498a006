"""Sources: file readers by type, normalisation of raw rows to typed tables."""
