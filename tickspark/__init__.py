"""tickspark: market back-testing and analytics as DataFrame plans."""

__version__ = "0.1.0"
