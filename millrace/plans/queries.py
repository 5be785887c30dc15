"""Imports every module that registers queries."""

from millrace.plans import admin, content, graph, relational, search, signals  # noqa: F401
