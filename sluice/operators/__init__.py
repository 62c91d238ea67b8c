"""Operators of the streaming lake."""
