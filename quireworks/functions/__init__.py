"""Column expressions over text, amounts, boxes and rules."""
