"""Tidewater plans."""
