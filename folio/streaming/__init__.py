"""Stateful processing of captures as they arrive."""
