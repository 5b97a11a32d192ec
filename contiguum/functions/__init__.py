"""Part of contiguum."""
