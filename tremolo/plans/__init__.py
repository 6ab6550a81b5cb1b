"""Plans of the signal engine."""
