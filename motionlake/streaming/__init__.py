"""Streaming forms of the window operators: an extension, since the batch inputs are bounded."""
