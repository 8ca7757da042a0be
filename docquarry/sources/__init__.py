"""Where collections come from and where they are kept."""
