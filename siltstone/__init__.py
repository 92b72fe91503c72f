"""Spark-native analytics over lakes of git histories: lineage, copies, folder imports, and general history operators."""
