"""DataFrame operators over tracks, windows, vectors and pairs."""
