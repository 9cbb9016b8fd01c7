"""Spatial order-rider matching analytics as Spark DataFrame operators."""
