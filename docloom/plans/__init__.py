"""Whole queries: guarded SQL, the engine's facade and the catalogue."""
