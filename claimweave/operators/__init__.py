"""Set operators over claims and references."""
