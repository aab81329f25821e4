"""Registered queries of the core and the SQL they are held against."""

from . import engines, general, keeping, measuring, retrieving, texts

MODULES = (general, texts, retrieving, engines, measuring, keeping)
