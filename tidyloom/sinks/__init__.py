"""Tables to files and tables."""

from .tables import publish_data, save_data

__all__ = ["publish_data", "save_data"]
