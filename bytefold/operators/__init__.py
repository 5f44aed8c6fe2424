"""Relational operators over chunks, runs, hits and store tables."""
