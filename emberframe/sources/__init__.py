"""Flat column files, generators, the CSV converter, and copies to Parquet and CSV."""

from .files import copy_from, copy_to
from .flat import FlatColumnSource, read_flat, write_flat
from .generate import csv_to_flat, generated, join_fixture, series

__all__ = ["FlatColumnSource", "copy_from", "copy_to", "csv_to_flat", "generated", "join_fixture", "read_flat", "series", "write_flat"]
