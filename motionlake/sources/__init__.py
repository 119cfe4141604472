"""Scans, decoders, derived views and sinks."""
