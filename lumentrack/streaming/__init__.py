"""streaming of lumentrack."""
