"""plans of the construct-verification engine."""
