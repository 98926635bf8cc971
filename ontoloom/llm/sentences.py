"""The sentence operator of the core, under its former name."""

from ontoloom.operators.sentences import QUOTE, segment, units

__all__ = ["QUOTE", "segment", "units"]
