"""Registered queries; importing the package files them."""

from tipoff.plans import features  # noqa: F401
from tipoff.plans import tournament  # noqa: F401
from tipoff.plans import names  # noqa: F401
