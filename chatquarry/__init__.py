"""Conversation analytics as lazy DataFrame operators."""
