"""Flow definitions and their batch composition."""
