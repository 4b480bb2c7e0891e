"""streaming of the construct-verification engine."""
