"""Readers and writers. Every reader takes an explicit schema; nothing is inferred."""
