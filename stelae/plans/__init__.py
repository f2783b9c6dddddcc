"""Registered queries: each joins an operator to the driver tables and names its SQL."""
