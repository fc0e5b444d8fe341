"""Dataset-level analyses."""
