"""Text-corpus engine: plans."""
