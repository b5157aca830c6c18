"""Readers, writers and panels."""
