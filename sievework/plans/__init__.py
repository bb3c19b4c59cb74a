"""Whole checks: operators composed into findings, checks and a status."""
