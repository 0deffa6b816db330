"""Structured Streaming: keyed chat-session history."""
