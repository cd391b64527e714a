"""DataFrame operators on commands and graphs."""
