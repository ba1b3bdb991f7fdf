"""Column -> Column building blocks. Nothing here shuffles."""
