"""Part of millwright; see the README."""
