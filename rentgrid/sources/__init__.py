"""Scans: listing documents, tables with an active flag, stored pages, feeds, sidecars."""
