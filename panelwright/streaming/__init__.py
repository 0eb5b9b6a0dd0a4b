"""Panelwright streaming."""
