"""Readers and parsers that turn files and payloads into relations."""
