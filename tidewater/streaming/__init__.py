"""Tidewater streaming."""
