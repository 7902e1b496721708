"""Renderings of findings and inventories."""
