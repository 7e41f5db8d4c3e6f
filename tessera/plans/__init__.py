"""Registered queries: engine operators composed over the driver's tables."""
