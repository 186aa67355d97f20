"""Part of quarterline."""
