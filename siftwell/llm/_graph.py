"""Connected components, from the library."""

from siftwell.operators.components import components

__all__ = ["components"]
