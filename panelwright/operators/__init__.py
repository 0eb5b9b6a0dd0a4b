"""Panelwright operators."""
