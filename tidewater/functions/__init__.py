"""Tidewater functions."""
