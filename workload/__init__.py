"""The operators bound to the driver's tables, with an independent SQL form of each."""
