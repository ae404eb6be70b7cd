"""Whole plans: index building, batch answering, evaluation, driver queries."""
