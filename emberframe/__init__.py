"""A resident-column analytics engine on the DataFrame API."""

__version__ = "0.1.0"
