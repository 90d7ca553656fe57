"""Citation evidence as Spark tables: capture, gate, chain, audit, review."""

__version__ = "0.1.0"
