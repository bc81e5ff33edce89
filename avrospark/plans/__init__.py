"""Plans: schema resolution compiled to Catalyst columns."""

from .resolve import matches, needed_fields, resolve

__all__ = ["matches", "needed_fields", "resolve"]
