"""Registered queries over the driver's tables."""

from . import business, events, identity, panel, paths, reports, research, studies  # noqa: F401
