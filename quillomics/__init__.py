"""Biomedical perturbation, expression and genetics analytics on PySpark DataFrames."""
