"""Operators on trajectories, steps and groups of them."""
