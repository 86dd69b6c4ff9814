"""Text-corpus engine: operators."""
