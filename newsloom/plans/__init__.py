"""Query plans and the few runtime helpers they share."""
