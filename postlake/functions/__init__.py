"""Scalar functions as Column expressions, and the few Arrow functions that need positions or recursion."""
