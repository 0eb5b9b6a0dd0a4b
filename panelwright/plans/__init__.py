"""Panelwright plans."""
