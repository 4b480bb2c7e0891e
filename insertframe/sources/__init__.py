"""sources of the construct-verification engine."""
