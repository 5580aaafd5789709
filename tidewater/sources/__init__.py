"""Tidewater sources."""
