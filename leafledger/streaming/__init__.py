"""Subscriptions and continuous state on Structured Streaming."""
