"""The stateless operators and the moving average over streams."""
