"""Betslip-flow analytics as PySpark DataFrame transforms."""
