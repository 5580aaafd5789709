"""Tidewater operators."""
