"""Readers, writers and data derivation."""
