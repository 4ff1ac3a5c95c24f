"""Scalar functions: Column builders, and Arrow functions where SQL can't say it."""
