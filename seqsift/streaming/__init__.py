"""Standing queries over tracks that arrive over time."""
