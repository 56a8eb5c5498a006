"""Tessera: a PySpark-native batch research engine over bars, factors, labels and portfolios."""
