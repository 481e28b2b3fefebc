"""Stores: versioned tables and the plans that change them."""
