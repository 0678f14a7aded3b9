"""Assembly of translations as they arrive."""
