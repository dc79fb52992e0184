"""Generic operators on DataFrames."""
from .bucketed import BucketedTable  # noqa: F401
from .core import *  # noqa: F403
from .ranks import ranked  # noqa: F401
from .upsert import upsert  # noqa: F401
