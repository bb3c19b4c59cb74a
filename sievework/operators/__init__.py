"""Relational operators over the engine's relations."""
