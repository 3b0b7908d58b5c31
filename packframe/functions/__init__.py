"""Column functions; none shuffles."""
