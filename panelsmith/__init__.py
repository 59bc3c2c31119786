"""panelsmith: entity x time panel analytics and imbalanced classification on Spark."""

__version__ = "0.1.0"
