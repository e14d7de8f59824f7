"""Configuration, the staged run, and the projections of the driver's tables."""
