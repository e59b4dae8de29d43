"""The engine's queries and the SQL that checks them."""

from . import events, files, fitted, forecasts, learned, modulation, physics, resampling, scores, series, sky  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
