"""Hashes, types and pods."""
