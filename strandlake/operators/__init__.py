"""DataFrame operators with parameterised column names."""
