"""corvidex: streaming."""
