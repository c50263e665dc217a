"""Connected components of an edge table."""
from __future__ import annotations

from ..operators.components import components  # noqa: F401
