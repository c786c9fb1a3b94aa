"""Part of the linkloom engine."""
