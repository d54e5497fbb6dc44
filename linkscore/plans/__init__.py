"""Whole runs: pages and keywords to ranked links."""
