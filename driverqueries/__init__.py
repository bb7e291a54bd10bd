"""One query per operator on the driver's tables, next to an independent SQL form of the same result."""
