"""Sanctions, public contracts and company ownership, crossed on Spark."""
