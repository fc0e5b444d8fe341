"""Registered tables, the read-only SQL policy and the bounded select."""
