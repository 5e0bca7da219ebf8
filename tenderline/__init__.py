"""Procurement analytics and corpus operations on Spark."""
