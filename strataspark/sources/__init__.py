"""strataspark.sources"""
