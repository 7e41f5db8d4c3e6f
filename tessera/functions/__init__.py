"""Column functions: no Python runs in any of them."""
