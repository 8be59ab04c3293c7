"""Registered queries and their SQL twins."""

from importlib import import_module

SECTIONS = ["base_queries", "window_queries", "model_queries", "stream_queries"]


def load_all():
    for section in SECTIONS:
        import_module(f"accesslens.catalog.{section}")
