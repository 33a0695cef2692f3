"""Training-data operators: ten corpus components that nothing else in the library imports."""
