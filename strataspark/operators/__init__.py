"""strataspark.operators"""
