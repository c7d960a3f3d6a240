"""DataFrame operators, one module a subject."""
