"""Spark-native engine for triaging reported mail and preparing training text."""
