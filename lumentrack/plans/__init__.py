"""plans of lumentrack."""
