"""Text-corpus engine: functions."""
