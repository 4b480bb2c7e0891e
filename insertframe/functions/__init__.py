"""functions of the construct-verification engine."""
