"""Conversation analytics as Spark DataFrame transforms."""
