"""Readers and writers."""

from .readers import *  # noqa: F401,F403
