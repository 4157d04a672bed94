"""Training-data operators: text, vectors and mixtures at corpus scale."""
