"""sources of lumentrack."""
