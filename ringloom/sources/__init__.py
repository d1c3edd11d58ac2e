"""Readers and writers for images, catalogues, rules, sidecars and run parameters."""
