"""Small neural networks: layers on NumPy arrays, trained and applied over DataFrames."""
