"""Part of the treeloom engine."""
