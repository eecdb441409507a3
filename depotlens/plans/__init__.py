"""The table store and the facade over it."""

from .engine import Inventory  # noqa: F401
from .store import Store  # noqa: F401
