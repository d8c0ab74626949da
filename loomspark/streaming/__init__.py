"""Streaming sources, mixing and monitoring."""
