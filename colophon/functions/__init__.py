"""Part of colophon; see the README for the map."""
