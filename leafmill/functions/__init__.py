"""Column functions: no shuffle, no action, usable inside any DataFrame query."""
