"""Readers and writers. Every reader returns a lazy DataFrame."""
