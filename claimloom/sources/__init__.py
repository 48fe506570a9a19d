"""Readers that turn files and tables into the engine's schemas."""
