"""Scalar functions on columns; none leaves the JVM."""
from .scalars import *  # noqa: F403
