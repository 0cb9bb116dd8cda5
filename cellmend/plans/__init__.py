"""End-to-end plans and queries."""
