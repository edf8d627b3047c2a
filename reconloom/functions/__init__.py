"""Column functions: allocation keys, amounts, text. All are built-in expressions, so they stay in generated code."""
