"""Streaming of the streaming lake."""
