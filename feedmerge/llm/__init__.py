"""Training-data corpus operators; nothing else in the library imports this."""
