"""storepulse: marketplace revenue and lifecycle analytics as Spark jobs."""

from storepulse.rules import Rules

__all__ = ["Rules"]
