"""Sources of the streaming lake."""
