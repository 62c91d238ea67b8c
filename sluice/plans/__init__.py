"""Plans of the streaming lake."""
