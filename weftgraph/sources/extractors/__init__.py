"""Extractors of nodes and edges from source files, one for each language."""

from .base import Extraction, Registry, default_registry

__all__ = ["Extraction", "Registry", "default_registry"]
