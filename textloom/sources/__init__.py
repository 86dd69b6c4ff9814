"""Text-corpus engine: sources."""
