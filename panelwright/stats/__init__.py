"""Panelwright stats."""
