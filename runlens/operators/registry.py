"""Models by name: how to score a row and which loss trains it."""

from runlens.operators import linear

MODELS = {
    "logistic_regression": (linear.predict_logistic, "BCE"),
    "ridge_regression": (linear.predict_ridge, "MSE"),
}


def model(name: str) -> tuple:
    """(score function, loss name) of a registered model."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    return MODELS[name]
