"""Column functions and helpers; ``tidalframe`` registers its package for pickling by value."""
