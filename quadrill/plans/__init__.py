"""Options, settings, cost estimates and the choice of a path."""
