"""Panelwright sources."""
