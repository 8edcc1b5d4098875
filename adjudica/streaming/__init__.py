"""Structured Streaming over progress events and suppression actions."""
