"""phenoloom: a PySpark-native engine for genotype-phenotype analytics on large marker x sample tables."""

__version__ = "0.1.0"
