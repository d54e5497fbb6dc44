"""Inputs: pages with their errors, robots rules, targets."""
