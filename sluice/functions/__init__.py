"""Functions of the streaming lake."""
