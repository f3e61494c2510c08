"""Readers of captured files and entity pages."""
