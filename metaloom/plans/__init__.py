"""Query plans bound to the driver tables."""
