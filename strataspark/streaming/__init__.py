"""strataspark.streaming"""
