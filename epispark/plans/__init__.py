"""The three end-to-end flows."""
