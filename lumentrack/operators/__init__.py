"""operators of lumentrack."""
