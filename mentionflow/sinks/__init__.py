"""Sinks and text layouts."""
