"""Part of askalot."""
