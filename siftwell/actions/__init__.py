"""Plans of what to do with duplicates, their execution on the driver, and how to undo it."""
