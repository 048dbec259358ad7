"""corvidex: llm."""
