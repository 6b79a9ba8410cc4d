"""Registered queries; importing the package registers them all."""

from . import registry  # noqa: F401  isort: skip
from . import operator_queries  # noqa: F401
from . import mechanism_queries  # noqa: F401
