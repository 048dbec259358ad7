"""corvidex: plans."""
