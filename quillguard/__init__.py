"""Text-governance analytics as DataFrame transforms."""
