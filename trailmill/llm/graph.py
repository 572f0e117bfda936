"""Connected components, where the operators of this subpackage look for them."""

from trailmill.operators.components import components

__all__ = ["components"]
