"""Column-level building blocks (all Catalyst built-ins, no UDFs)."""
