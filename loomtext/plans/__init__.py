"""Options that specialize plans, and the registered queries."""
