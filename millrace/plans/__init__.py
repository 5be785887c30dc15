"""Query plans: the registered queries and their oracles."""
