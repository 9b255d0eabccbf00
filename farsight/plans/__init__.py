"""Whole-scan plans and the functions users can plug into them."""
