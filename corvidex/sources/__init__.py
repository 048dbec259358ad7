"""corvidex: sources."""
