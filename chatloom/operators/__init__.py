"""DataFrame-to-DataFrame operators of the chat archive engine."""
