"""Scans and writes."""
