"""Style factors, risk model, formulaic alphas, backtest and their statistics."""
