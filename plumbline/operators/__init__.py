"""Transformations of labelled-window tables: DataFrame in, DataFrame out."""
