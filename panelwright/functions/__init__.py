"""Panelwright functions."""
