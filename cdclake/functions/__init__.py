"""Column helpers; every one of them is a built-in expression."""
