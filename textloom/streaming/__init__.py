"""Text-corpus engine: streaming."""
