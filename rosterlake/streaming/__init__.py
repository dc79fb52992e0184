"""Checks and aggregates on streams."""
from .checks import *  # noqa: F403
from .stateful import *  # noqa: F403
