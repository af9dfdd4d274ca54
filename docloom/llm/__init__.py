"""Training-data operators: one module per operator, and ``catalog`` with their registered queries."""
