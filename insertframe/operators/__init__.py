"""operators of the construct-verification engine."""
